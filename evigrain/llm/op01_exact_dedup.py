"""Exact dedup by deterministic block naming, in DataFrame operations only.

Each text, lower-cased for A-Z, is cut into blocks of ``block_bytes`` bytes.

1. All distinct blocks are sorted within hash partitions and numbered: equal
   blocks get one integer name, different blocks different ones. The blocks
   themselves are the grouping key, so names have no collisions; copies of a
   hot block are folded before the shuffle.
2. Names of adjacent blocks are paired, distinct pairs are sorted and numbered
   in turn, and so on until a document has one name. (number of blocks, name)
   is its identity.

A document that holds a block (or a pair) found nowhere else already has an
identity of its own, so it takes no part in the later rounds. Occurrences find
their name by a 96-bit digest of the block rather than by its bytes; if two
blocks ever share a digest, the round is done again by the bytes. Hot names are
salted in these joins. Names are written to the shared folder before anything
reads them, so a lost executor can't renumber them.

Defined cases: one row for each input row; null and empty texts are equal; of
equal texts the row with the largest key stays (one with a null key only if
there is no other); rows that have both key and text in common count one each,
and stay or go together; texts of any length are read whole; an empty table
gives an empty result; other input columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, salted_join, text_or_empty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands for a document: key and hash of the text, how many rows it is, and its blocks.
DOC = ["__id", "__fp", "__rows", "__blocks"]


def normalised(text: Column) -> Column:
    """A-Z in lower case. Of a text of ASCII only, lower() does just that, and faster."""
    t = text_or_empty(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; plain columns may be inlined at each use."""
    return F.transform(F.array(value), body)[0]


def _blocks(raw: Column, size: int) -> Column:
    last = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / size).cast("int")) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _prepared(docs: DataFrame, text: str, key: str, fields: Callable[[Column], Column]) -> DataFrame:
    """__id, __fp and what ``fields`` makes of the normalised bytes."""
    made = let(normalised(F.col(text)).cast("binary"), lambda raw: F.struct(F.xxhash64(raw).alias("__fp"), fields(raw).alias("__made")))
    return docs.select(F.col(key).alias("__id"), made.alias("__doc")).select("__id", "__doc.__fp", "__doc.__made")


def _numbered(groups: DataFrame, by: list[str], what: str) -> DataFrame:
    """Sort the distinct keys and number them; written, as numbers must not change."""
    return written(groups.sortWithinPartitions(*by).withColumn("__name", F.monotonically_increasing_id()), what)


def _first_round(docs: DataFrame, base: DataFrame, text: str, key: str, size: int, digest) -> DataFrame:
    """(document, number of blocks, position, name) of blocks found more than once."""
    cut = _prepared(docs, text, key, lambda raw: _blocks(raw, size))
    blocks = cut.select(F.explode("__made").alias("__block")).select("__block", *digest(F.col("__block")))
    found = blocks.groupBy("__h1", "__h2", "__block").agg(F.count("*").alias("__n"))
    names = written(found.sortWithinPartitions("__block").select("__h1", "__h2", F.monotonically_increasing_id().alias("__name"), "__n"), "names")
    if names.groupBy("__h1", "__h2").count().where("count > 1").isEmpty():
        places = base.select(*DOC, F.posexplode("__digests").alias("__pos", "__d")).select(*DOC, "__pos", "__d.__h1", "__d.__h2")
        return salted_join(places, names.where("__n > 1"), ["__h1", "__h2"], "__n", F.col("__fp")).select(*DOC, "__pos", "__name")
    names = _numbered(blocks.groupBy("__block").agg(F.count("*").alias("__n")), ["__block"], "names")
    places = cut.select("__id", "__fp", F.size("__made").alias("__blocks"), F.posexplode("__made").alias("__pos", "__block"))
    places = places.groupBy("__id", "__fp", "__blocks", "__pos").agg(F.count("*").alias("__rows"), F.first("__block").alias("__block"))
    return salted_join(places, names.where("__n > 1"), ["__block"], "__n", F.col("__fp")).select(*DOC, "__pos", "__name")


def _whole(named: DataFrame, places: Column) -> DataFrame:
    """Only documents all of whose places got a name that another place has."""
    full = named.groupBy("__id", "__fp", "__blocks").agg(F.count("*").alias("__got")).where(F.col("__got") == places).select(F.col("__id").alias("__i"), F.col("__fp").alias("__f"))
    return named.join(full, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__fp") == F.col("__f")), "left_semi")


def default_digest(block: Column) -> list[Column]:
    return [F.xxhash64(block).alias("__h1"), F.hash(block).alias("__h2")]


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", block_bytes: int = 2048, digest=default_digest) -> DataFrame:
    """One row per document: ``key``, keep_id, group_size, kept, text_sha256.

    ``digest`` gives the columns __h1 and __h2 of a block; it only steers how
    occurrences find their names.
    """
    digests = _prepared(docs, text, key, lambda raw: F.struct(F.sha2(raw, 256).alias("text_sha256"), F.transform(_blocks(raw, block_bytes), lambda b: F.struct(*digest(b))).alias("__digests")))
    # rows with key and text in common go through the rounds once, with their number
    found = digests.select("__id", "__fp", "__made.*").groupBy("__id", "__fp", "text_sha256").agg(F.count("*").alias("__rows"), F.first("__digests").alias("__digests"))
    base = written(found.withColumn("__blocks", F.size("__digests")), "documents")
    named = written(_whole(_first_round(docs, base, text, key, block_bytes, digest), F.col("__blocks")), "round0")
    left, done = 1, []
    while True:
        done.append(named.where(F.col("__blocks") <= left))
        longer = named.where(F.col("__blocks") > left)
        if longer.isEmpty():
            break
        pairs = longer.groupBy(*DOC, F.expr("__pos div 2").cast("int").alias("__pos")).agg(
            F.max(F.when(F.col("__pos") % 2 == 0, F.col("__name"))).alias("__a"),
            F.coalesce(F.max(F.when(F.col("__pos") % 2 == 1, F.col("__name"))), F.lit(-1)).alias("__b"),
        )
        pairs = written(pairs, "pairs")
        names = _numbered(pairs.groupBy("__a", "__b").agg(F.count("*").alias("__n")), ["__a", "__b"], "names")
        left *= 2
        named = written(_whole(salted_join(pairs, names.where("__n > 1"), ["__a", "__b"], "__n", F.col("__fp")).select(*DOC, "__pos", "__name"), F.ceil(F.col("__blocks") / left)), "round")
        dropped(pairs)
    # a name stands for its own round only, which the number of blocks fixes
    ready = done[0]
    for d in done[1:]:
        ready = ready.unionByName(d)
    ready = ready.select(*DOC, "__name")
    groups = written(ready.groupBy("__blocks", "__name").agg(F.max("__id").alias("keep_id"), F.sum("__rows").alias("group_size")), "groups")
    member = salted_join(ready, groups, ["__blocks", "__name"], "group_size", F.col("__fp")).select(F.col("__id").alias("__i"), F.col("__fp").alias("__f"), "keep_id", "group_size")
    out = base.select(*DOC, "text_sha256").join(member, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__fp") == F.col("__f")), "left")
    # a document whose blocks are all found once is one row: its group is known without a name
    alone = F.col("group_size").isNull()
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__rows").cast("int")))).select(
        F.col("__id").alias(key),
        F.when(alone, F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
