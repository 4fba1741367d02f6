"""What is written out: decision tables, queues, bibliographies, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type of each document type in a citation processor's JSON.
CSL_TYPES = {"Journal Article": "article-journal", "Thesis": "thesis", "Conference Proceeding": "paper-conference"}


def csl(records: DataFrame) -> DataFrame:
    """record_id and the record as a citation processor's JSON."""

    def person(name: Column) -> Column:
        comma = F.contains(name, F.lit(","))
        family = F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(name, r"\s+"), -1))
        given = F.when(comma, F.trim(F.substring_index(name, ",", -1))).otherwise(F.trim(F.regexp_replace(name, r"\s*\S+$", "")))
        return F.struct(family.alias("family"), F.nullif(given, F.lit("")).alias("given"))

    kind = F.create_map(*(F.lit(x) for p in CSL_TYPES.items() for x in p))[F.col("document_type")]
    item = F.struct(
        F.col("record_id").alias("id"), F.coalesce(kind, F.lit("article")).alias("type"), "title",
        F.transform("authors", person).alias("author"),
        F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts"))).alias("issued"),
        F.col("journal").alias("container-title"), F.nullif("doi", F.lit("NR")).alias("DOI"), F.col("url").alias("URL"),
    )
    return records.select("record_id", F.to_json(item).alias("csl"))


def arbitration_queue(decisions: DataFrame, path: str) -> None:
    """The rows that somebody must decide, as JSON lines."""
    decisions.where("outcome = 'ARBITRATION'").write.mode("overwrite").json(path)


def decision_csv(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("overwrite").csv(path, header=True)


def argument_graph(claims: DataFrame, k: int = 5) -> DataFrame:
    """Per topic a Mermaid graph of its k heaviest claims of each stance."""
    from ..operators.ordered import top_k

    top = top_k(claims.where("stance is not null"), ["topic", "stance"], [F.col("weight").desc(), F.col("claim_id")], k)
    edge = F.format_string('  C%s["%s %.3f"] --> T', "claim_id", "stance", "weight")
    # k rows a stance: the list is bounded
    rows = top.groupBy("topic").agg(F.array_sort(F.collect_list(edge)).alias("__e"))
    return rows.select("topic", F.concat(F.lit("graph LR\n"), F.array_join("__e", "\n")).alias("mermaid"))
