"""Connected components by least labels, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, salted_join, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node that can be reached, for every node with a link.

    Each round a node takes the least of its label, its neighbours' labels and
    its label's label, so that paths shorten by about half; each round's labels
    are written. Nodes with many links and labels with many nodes are salted.
    """
    ends = F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))
    both = written(links.select(F.explode(ends).alias("e")).select("e.*").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.count("*").alias("links"), F.min("other").alias("least")).select("node", "links", F.least("node", "least").alias("label")), "labels")
    size = labels.agg(F.count("*").alias("nodes"), F.sum("links").alias("links")).first()
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("links").alias("__n"), F.col("label").alias("near"))
        near = salted_join(both, known, ["other"], "__n", F.col("node"), total=size["links"] or 0).groupBy("node").agg(F.min("near").alias("near"))
        up = labels.groupBy("label").agg(F.count("*").alias("__n")).join(labels.select(F.col("node").alias("label"), F.col("label").alias("root")), "label")
        new = salted_join(labels, up, ["label"], "__n", F.col("node"), total=size["nodes"]).drop("__n").join(near, "node")
        new = written(new.select("node", "links", F.col("label").alias("old"), F.least("label", "near", "root").alias("label")), "labels")
        changed = not new.where("label < old").isEmpty()
        dropped(labels)
        labels = new.drop("old")
        if not changed:
            dropped(both)
            return labels.select("node", "label")
