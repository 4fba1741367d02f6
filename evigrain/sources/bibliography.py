"""Bibliographic exports as DataFrames: RIS, EndNote, RefWorks, CSV and event logs.

Tagged files are read whole, one file a row, cut into records by a split, and
into (tag, values) by higher-order functions; no record leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import clean, doi_key, items, record_id, title_key, year_of

#: Where a record ends, what a tagged line looks like, and the tags of each field, in order of preference.
RIS = {
    "end": r"(?i)\bER\s*-[ \t]*",
    "line": r"^([A-Za-z0-9]{2})\s*-\s*(.*)$",
    "type": ["TY"], "title": ["TI", "T1"], "authors": ["AU", "A1"], "year": ["PY", "Y1", "DA"], "journal": ["JO", "JF", "T2", "SO"],
    "abstract": ["AB", "N2"], "keywords": ["KW"], "doi": ["DO", "DI"], "url": ["UR"], "publisher": ["PB"],
}
ENDNOTE = {
    "end": r"\n\s*\n(?=%0)", "line": r"^(%[0-9A-Z])\s*(.*)$",
    "type": ["%0"], "title": ["%T"], "authors": ["%A"], "year": ["%D"], "journal": ["%J"], "abstract": ["%X"], "keywords": ["%K"], "doi": ["%R"], "url": ["%U"], "publisher": ["%I"],
}
REFWORKS = {
    "end": r"\n(?=RT\s*[-:]?\s)", "line": r"^([A-Z][A-Z0-9])\s*[-:]?\s+(.*)$",
    "type": ["RT"], "title": ["T1"], "authors": ["A1"], "year": ["YR"], "journal": ["JF"], "abstract": ["AB"], "keywords": ["K1"], "doi": ["DO"], "url": ["LK"], "publisher": ["PB"],
}
FIELDS = ["type", "title", "authors", "year", "journal", "abstract", "keywords", "doi", "url", "publisher"]


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text, lossy) of each file; bytes that are no UTF-8 are read as GB18030, and marked if even that loses some."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    raw = F.col("content").cast("string")
    utf8 = F.when(F.is_valid_utf8(raw), raw)
    gb = gb18030("content")
    read = F.regexp_replace(F.coalesce(utf8, gb), "^﻿", "")
    return files.select("path", F.regexp_replace(read, "\r\n?", "\n").alias("text")).withColumn("lossy", F.contains("text", F.lit("�")))


@F.pandas_udf(T.StringType())
def gb18030(raw: pd.Series) -> pd.Series:
    """Spark's decode() knows no GB18030; only files that are no UTF-8 need it."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def tagged(files: DataFrame, form: dict, source: str = "UNKNOWN_EXTERNAL_SOURCE") -> DataFrame:
    """Records of tagged files with the columns path, ordinal and those of :func:`finished`.

    Lines without a tag go on from the one before; records without a title are left out.
    """
    blocks = files.select("path", F.posexplode(F.split("text", form["end"])).alias("ordinal", "__block")).where(F.length(F.trim("__block")) > 0)
    trimmed = F.filter(F.transform(F.split("__block", "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    # each line as (tag, value); one without a tag has none
    line = F.transform(trimmed, lambda s: F.struct(F.upper(F.regexp_extract(s, form["line"], 1)).alias("tag"), F.when(s.rlike(form["line"]), F.trim(F.regexp_extract(s, form["line"], 2))).otherwise(s).alias("value")))
    start = F.array().cast("array<struct<tag:string,value:string>>")

    def add(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.struct(last["tag"].alias("tag"), F.concat(last["value"], F.lit(" "), x["value"]).alias("value"))))
        return F.when(x["tag"] != "", F.concat(held, F.array(x))).when(F.size(held) > 0, joined).otherwise(held)

    rows = blocks.withColumn("__lines", F.aggregate(line, start, add))

    def values(tags: Sequence[str]) -> Column:
        """The values of the first of these tags that the record has."""
        lists = [F.transform(_with_tag(t), lambda x: x["value"]) for t in tags]
        return F.coalesce(*(F.when(F.size(v) > 0, v) for v in lists), F.array().cast("array<string>"))

    raw = rows.select("path", "ordinal", *(values(form[f]).alias(f) for f in FIELDS))
    return finished(raw, source)


def _with_tag(tag: str) -> Column:
    return F.filter("__lines", lambda x: x["tag"] == tag)


def finished(raw: DataFrame, source: str) -> DataFrame:
    """Typed records from arrays of raw values; ``raw`` has path, ordinal and :data:`FIELDS`."""

    def text(name: str) -> Column:
        return F.nullif(clean(F.array_join(name, " ")), F.lit(""))

    kind = F.upper(F.coalesce(text("type"), F.lit("")))
    thesis = kind.isin("THES", "DISSERTATION") | F.lower(kind).rlike("thesis|dissertation")
    out = raw.select(
        "path", "ordinal",
        text("title").alias("title"),
        F.filter(F.transform("authors", clean), lambda a: F.length(a) > 0).alias("authors"),
        year_of(F.array_join("year", " ")).alias("year"),
        text("journal").alias("journal"),
        F.coalesce(doi_key(F.nullif(F.regexp_extract(F.array_join("doi", " "), r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b", 1), F.lit(""))), F.lit("NR")).alias("doi"),
        text("url").alias("url"),
        text("abstract").alias("abstract"),
        items(F.array_join("keywords", ";")).alias("keywords"),
        F.when(thesis, "Thesis").when(kind.isin("CONF", "CPAPER", "CONFERENCE PROCEEDINGS"), "Conference Proceeding").otherwise("Journal Article").alias("document_type"),
        F.when(thesis, F.coalesce(text("publisher"), text("journal"))).alias("institution"),
    )
    out = out.where("title is not null")
    return out.withColumns({
        "record_id": record_id(F.col("doi"), F.col("title"), F.col("year"), F.try_element_at("authors", F.lit(1))),
        "title_key": title_key(F.col("title")),
        "source_databases": F.array(F.lit(source)),
    })


#: Parts of a header that name a field, in order; a later column wins over an earlier one.
HEADERS = {
    "title": ["title", "题名", "标题"], "authors": ["author", "作者"], "year": ["year", "date", "时间", "年"], "journal": ["journal", "source", "刊名", "来源"],
    "abstract": ["abstract", "摘要"], "keywords": ["keyword", "关键词"], "doi": ["doi"], "url": ["url", "link", "链接"],
}


def csv_records(spark: SparkSession, path: str, separator: str = ",", source: str = "UNKNOWN_EXTERNAL_SOURCE") -> DataFrame:
    """Records of a CSV or TSV file whose columns are found by their headers; no title column, no rows."""
    rows = spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"')
    found: dict[str, str] = {}
    for name in rows.columns:
        low = name.lower()
        field = next((f for f, parts in HEADERS.items() if any(p in low for p in parts)), None)
        if field:
            found[field] = name

    def values(field: str) -> Column:
        if field not in found:
            return F.array().cast("array<string>")
        c = F.col(f"`{found[field]}`")
        return F.when(c.isNotNull(), items(c, "[;,，；]") if field == "authors" else F.array(c)).otherwise(F.array().cast("array<string>"))

    raw = rows.withColumn("__n", F.monotonically_increasing_id()).select(F.input_file_name().alias("path"), F.col("__n").alias("ordinal"), *(values(f).alias(f) for f in FIELDS))
    return finished(raw if "title" in found else raw.where(F.lit(False)), source)


def sniffed(files: DataFrame) -> DataFrame:
    """(path, format) by what a file's text looks like."""
    form = F.when(F.col("text").rlike(r"(?m)^RT\s"), "REFWORKS").when(F.col("text").rlike(r"(?mi)^TY\s*-"), "RIS").when(F.col("text").rlike(r"(?m)^%0\s"), "ENDNOTE").otherwise("UNKNOWN")
    return files.select("path", form.alias("format"))


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """All tagged records under a folder, whatever their formats."""
    files = texts(spark, path)
    known = files.join(sniffed(files), "path")
    parts = [tagged(known.where(F.col("format") == name), form) for name, form in (("RIS", RIS), ("ENDNOTE", ENDNOTE), ("REFWORKS", REFWORKS))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EVENT = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.StringType()), ("session_id", T.StringType()), ("seq", T.LongType()), ("type", T.StringType()), ("payload", T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])), ("created_at", T.TimestampType()), ("applied", T.BooleanType()))])


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(Events, quarantined lines) of JSON-lines logs. A line that is no event is TORN_TAIL if it is its file's last, else CORRUPT."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line"), "value").where("trim(value) <> ''")
    parsed = lines.withColumn("e", F.from_json("value", EVENT))
    bad = F.col("e").isNull() | F.col("e.event_id").isNull() | F.col("e.seq").isNull()
    last = lines.groupBy("path").agg(F.max("line").alias("__last"))
    wrong = parsed.where(bad).join(last, "path").select("path", "line", "value", F.when(F.col("line") == F.col("__last"), "TORN_TAIL").otherwise("CORRUPT").alias("reason"))
    return parsed.where(~bad).select("e.*"), wrong


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Markdown text as blocks: section heading, kind (heading, eq, table, figure, p), text, and an id from content and occurrence."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    heading = F.col("raw").rlike(r"^#{1,6}\s")
    kind = F.when(heading, "heading").when(F.col("raw").startswith("$$"), "eq").when(F.lower("raw").startswith("<table"), "table").when(F.col("raw").rlike(r"^!\["), "figure").otherwise("p")
    marked = lines.withColumn("section", F.last(F.when(heading, F.regexp_replace("raw", r"^#+\s*", "")), True).over(w)).withColumn("kind", kind).where(F.length("raw") > 0)
    nth = F.row_number().over(W.partitionBy(key, "raw").orderBy("line"))
    return marked.select(key, "line", "section", "kind", "raw", F.concat(F.left(F.sha2("raw", 256), F.lit(12)), F.lit("-"), nth).alias("block_id"))
