"""Packing: optimal length buckets and token-budget batches.

The histogram has a row for every length that occurs, whatever it is; a corpus
has as many as its longest text has tokens at most. Dynamic programming over it
picks ``buckets`` upper bounds (each a length that occurs) with the least total
padding of all choices. What a bound costs is lines in the length, so each
step finds the best by a lower envelope, in time that grows as the number of
lengths. A bucket's batches hold ``budget // bound`` documents each (one at
least), so a batch never pads to more than the budget unless one document alone
is longer.

Numbering the documents of a bucket needs no single task: they are dealt over
shards of about ``shard_rows`` by a hash of key and text, ranked within a
shard, and shifted by the sum of the shards before. So a bucket has one batch
that isn't full at most. Where the texts are kept, shards are also small enough
to hold about ``shard_bytes`` of them, so a bucket of long texts has more.

Defined cases: null and empty texts have length 0 and go to the first bucket;
every input row gets one place, rows in common one each; the order within a
shard is by key, nulls first, then by text hash; an empty table gives an empty
result; input columns other than those kept are dropped, and one named as an
output column gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fingerprint, text_or_empty, written


def words(text: Column) -> Column:
    """Length of a text in words: runs of characters that are no white space."""
    return F.regexp_count(text_or_empty(text), F.lit("\\S+")).cast("long")


def least_lines(slopes: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each j, which line i < j + 1 is least at ``at[j]``; slopes fall with i, ``at`` rises with j.

    The lower envelope is kept as a stack, for lines come with falling slopes;
    a query only moves on in it.
    """
    out = np.zeros(len(at), np.int64)
    stack: list[int] = []
    front = 0
    m, c = slopes.tolist(), offsets.tolist()

    def useless(x: int, y: int, z: int) -> bool:
        # whether y is nowhere below both x and z
        return (c[z] - c[x]) * (m[x] - m[y]) <= (c[y] - c[x]) * (m[x] - m[z])

    for j, x in enumerate(at.tolist()):
        if c[j] != np.inf:
            while len(stack) - front >= 2 and useless(stack[-2], stack[-1], j):
                stack.pop()
            stack.append(j)
        while len(stack) - front >= 2 and m[stack[front + 1]] * x + c[stack[front + 1]] <= m[stack[front]] * x + c[stack[front]]:
            front += 1
        out[j] = stack[front] if front < len(stack) else -1
    return out


def best_bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """The upper bounds, ``buckets`` at most, that pad ``counts`` items of ``lengths`` (ascending) least."""
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.float64)
    upto = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    # cost[j]: tokens with padding of the first j lengths; a bucket of lengths i to j - 1 pads them to the last
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    picks = []
    for _ in range(min(buckets, n)):
        pick = least_lines(-upto[:-1], cost[:-1], size)
        some = pick >= 0
        new = np.full(n + 1, np.inf)
        new[1:][some] = cost[pick[some]] + size[some] * (upto[1:][some] - upto[pick[some]])
        picks.append(pick)
        cost = new
    out, j = [], n
    for pick in reversed(picks):
        out.append(int(lengths[j - 1]))
        j = int(pick[j - 1])
    return out[::-1]


def pack(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: Column | None = None, keep: Sequence[str] = (), budget: int = 8192, buckets: int = 16, shard_rows: int = 50_000, shard_bytes: int = 16_000_000) -> DataFrame:
    """``key``, the columns to ``keep``, n_tokens, bucket, pad_to, batch, slot: each document's place.

    ``length`` counts a row's tokens (words of its text, if it isn't given).
    """
    made = ("n_tokens", "bucket", "pad_to", "batch", "slot")
    kept = [c for c in dict.fromkeys([key, *keep]) if c not in made]
    n = words(F.col(text)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    columns = [F.col(f"`{c}`") for c in kept]
    size = F.octet_length(text_or_empty(F.col(text))) if text in kept else F.lit(0)
    sized = written(docs.select(*columns, n.alias("n_tokens"), fingerprint(F.col(text)).alias("__fp"), size.cast("long").alias("__bytes")), "lengths")
    # as many rows as there are lengths: no more than the longest text has tokens
    bins = sized.groupBy("n_tokens").agg(F.count("*").alias("n"), F.sum("__bytes").alias("bytes")).orderBy("n_tokens").collect()
    bounds = best_bounds([max(r["n_tokens"], 1) for r in bins], [r["n"] for r in bins], buckets)
    if not bounds:
        kinds = {"n_tokens": "long", "bucket": "int", "pad_to": "long", "batch": "long", "slot": "long"}
        return sized.select(*columns, *(F.lit(0).cast(t).alias(c) for c, t in kinds.items()))
    inside = [[r for r in bins if lo < max(r["n_tokens"], 1) <= hi] for lo, hi in zip([0, *bounds], bounds, strict=False)]
    shards = [max(1, -(-sum(r["n"] for r in b) // shard_rows), -(-sum(r["bytes"] for r in b) // shard_bytes)) for b in inside]

    def by_bucket(values: Sequence[int]) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)

    bucket = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(bucket)
    dealt = sized.withColumn("bucket", bucket).withColumn("__shard", F.pmod(F.xxhash64(F.col(f"`{key}`"), "__fp"), by_bucket(shards)))
    sums = dealt.groupBy("bucket", "__shard").agg(F.count("*").alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(W.partitionBy("bucket").orderBy("__shard")) - F.col("__n")).select("bucket", "__shard", "__before")
    ranked = dealt.withColumn("__rank", F.row_number().over(W.partitionBy("bucket", "__shard").orderBy(f"`{key}`", "__fp")) - 1).join(before, ["bucket", "__shard"])
    place = ranked.withColumn("__place", F.col("__rank") + F.col("__before")).withColumn("__cap", by_bucket([max(1, budget // b) for b in bounds]))
    return place.select(
        *columns,
        "n_tokens",
        "bucket",
        by_bucket(bounds).alias("pad_to"),
        F.expr("__place div __cap").alias("batch"),
        (F.col("__place") % F.col("__cap")).alias("slot"),
    )
