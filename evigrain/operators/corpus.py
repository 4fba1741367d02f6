"""Record corpora: merging by key, contributions of sources, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frozen(records: DataFrame, keys: Sequence[Column], ordinal: str) -> DataFrame:
    """The first row of each key; the key is the first of ``keys`` that isn't null, rows without any stay.

    The first row is found by an aggregation that combines before its shuffle,
    not by sorting a key's rows.
    """
    named = records.withColumn("__key", F.coalesce(*(F.concat(F.lit(f"{i}:"), k.cast("string")) for i, k in enumerate(keys))))
    row = F.struct(*records.columns)
    kept = named.where("__key is not null").groupBy("__key").agg(F.min_by(row, ordinal).alias("__row"), F.count("*").alias("copies")).select("__row.*", "copies")
    return kept.unionByName(named.where("__key is null").drop("__key").withColumn("copies", F.lit(1).cast("long")))


def contributions(records: DataFrame, key: Column, source: str) -> DataFrame:
    """Per source: its distinct keys, and those that no other source has."""
    pairs = records.select(key.alias("__key"), source).where("__key is not null").distinct()
    sole = pairs.groupBy("__key").agg(F.count("*").alias("__n"), F.min(source).alias("__only"))
    unique = sole.where("__n = 1").groupBy(F.col("__only").alias(source)).agg(F.count("*").alias("unique_keys"))
    return pairs.groupBy(source).agg(F.count("*").alias("keys")).join(unique, source, "left").withColumn("unique_keys", F.coalesce("unique_keys", F.lit(0)))


def conflicts(records: DataFrame, key: Column, field: str) -> DataFrame:
    """Keys whose rows disagree in a field: how many rows and values, the least and the greatest value. Rows without a key stand alone."""
    out = records.where(key.isNotNull()).groupBy(key.alias("record_key")).agg(F.count("*").alias("rows"), F.count_distinct(field).alias("n_values"), F.min(field).alias("least"), F.max(field).alias("greatest"))
    return out.where("n_values > 1")


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of a, of b, in both, and in a only."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = x.join(y, key, "full")
    return both.agg(F.count("__a").alias("in_a"), F.count("__b").alias("in_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("in_both"), F.count_if(F.col("__b").isNull()).alias("only_a"))


def merge(existing: DataFrame, incoming: DataFrame, doi: str, title: str, fields: Sequence[str]) -> DataFrame:
    """Incoming rows met by DOI key, else by title key; existing values win, missing ones are filled in.

    The result has a row per existing record and per new incoming key, with
    ``origin`` of existing, merged or new.
    """
    def first(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ordinal").alias(name))

    met = incoming.withColumnRenamed("ordinal", "__in").join(first(existing, doi, "__by_doi"), doi, "left").join(first(existing, title, "__by_title"), title, "left")
    met = met.withColumn("__at", F.coalesce("__by_doi", "__by_title"))
    fill = met.where("__at is not null").groupBy("__at").agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col("__in"))).alias(f"__{f}") for f in fields))
    old = existing.join(fill, F.col("ordinal") == F.col("__at"), "left").select("ordinal", doi, title, *(F.coalesce(f, f"__{f}").alias(f) for f in fields), F.when(F.col("__at").isNotNull(), "merged").otherwise("existing").alias("origin"))
    new = met.where("__at is null").select(F.col("__in").alias("ordinal"), doi, title, *fields)
    new = frozen(new, [F.col(doi), F.col(title)], "ordinal").drop("copies").withColumn("origin", F.lit("new"))
    return old.unionByName(new.select(old.columns))
