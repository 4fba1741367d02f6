"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles.

Weights: a document's shingle (five words) weighs tf * idf, where idf is
1 + ln(1 / max(df / N, ``floor``)). So every shingle in less than ``floor`` of
the documents has the same idf, and only those more common than that need
their document frequency. A shingle that common overall is so, at half the
share, in runs of documents that together hold half of its occurrences: runs
report theirs (a short run may report all it has), reports are added up, and
what reaches half the share in all is counted exactly in a second pass. How
documents are cut into runs, files or partitions changes nothing. The
candidates number fewer than 2 / ``floor`` times the mean length of a document,
whatever the corpus; they are broadcast with that bound.

Samples: for each hash function, a shingle of weight w draws r and c from
Gamma(2, 1) and b from [0, 1), takes t = floor(ln w / r + b), and the shingle
with the least c / exp(r (t - b + 1)) is the sample, with its t. Two documents
agree in a sample with the probability of their weighted Jaccard similarity.

Links: documents with the same weighted shingles are one class, folded before
anything else. Classes that agree in all samples of a band share a bucket.

1. Buckets of up to :data:`SMALL` classes are compared whole. In larger ones
   every class is compared with one pivot, the class that shares most buckets.
2. Connected components are found. A pivot's component and all classes that
   share a large bucket with it are a crowd; those that aren't in the component
   are its rest. The rest is compared with the whole crowd, however large
   either is, exactly and in
   blocks of :data:`BLOCK` by as many: a block's weighted shingles are indexed,
   and what a text has in common with all of a block is summed at once, so no
   row is made for a pair.

So pairs within a group of near copies aren't all made, and no class is left
uncompared: only pairs of small buckets, or with a pivot, whose samples agree
too seldom for the threshold (once in 100,000 pairs that reach it) aren't read.
A pair at the threshold shares a bucket with a probability of 0.999. Pairs are decided by the exact
weighted Jaccard similarity of their whole texts; documents in one connected
component are a group.

Defined cases: one row for each input row; null and empty texts have no
shingles and stand alone; texts of one to four words have one shingle; a row is
known by its key and a hash of its text, so a key that stands for several texts
is told apart and equal rows are kept or dropped together; of a group, the row
with the least key stays (a null key only if there is no other; of equal keys
the text with the least hash); an empty table gives an empty result; other
input columns aren't read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fingerprint, map_arrow, runs, salted_join, task_cache, text_or_empty, written
from .graph import components
from .shingles import U, mix, parted, vectors

TABLE = 1 << 16
#: Bands, and samples a band.
BANDS, ROWS = 10, 3
#: Classes of a bucket that is compared whole.
SMALL = 16
#: Texts on either side of a block of comparisons.
BLOCK = 300
#: Samples whose low bytes are kept to sift pairs, and the words that hold them.
SKETCHED, WORDS = 30, ("__s0", "__s1", "__s2", "__s3")
#: Shingles held before a run of documents is reported.
HELD = 2_000_000


@task_cache
def draws() -> tuple[np.ndarray, np.ndarray]:
    """r and b for each value of a shingle hash's low 16 bits; which value a shingle has differs from function to function."""
    rng = np.random.default_rng(0)
    return rng.gamma(2.0, 1.0, TABLE), rng.random(TABLE)


@task_cache
def plain_factor(log_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(exp(-r (t - b + 1)), t) for the weight that nearly all shingles have."""
    r, b = draws()
    t = np.floor(log_weight / r + b)
    return np.exp(-r * (t - b + 1)), t


def samples(shingles: np.ndarray, weights: np.ndarray, counts: np.ndarray, n: int, plain: float, first: int = 0) -> np.ndarray:
    """The samples of each text by ``n`` hash functions from number ``first``, as 64-bit integers; texts without shingles have zeros."""
    out = np.zeros((len(counts), n), U)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    lengths = counts[some]
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(some)), lengths)
    odd = np.flatnonzero(weights != plain)
    log_odd = np.log(weights[odd])
    factor, t_plain = plain_factor(math.log(plain))
    all_r, all_b = draws()
    for k in range(n):
        h = mix(shingles + U((first + k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        low = (h & U(TABLE - 1)).astype(np.int64)
        # c from 48 further bits, as minus the log of a product of two uniforms
        u = ((h >> U(16)) & U(0xFFFFFF)).astype(np.float64) + 0.5
        u *= (h >> U(40)).astype(np.float64) + 0.5
        c = 48 * math.log(2) - np.log(u)
        a = c * factor[low]
        if len(odd):
            r, b = all_r[low[odd]], all_b[low[odd]]
            t_odd = np.floor(log_odd / r + b)
            a[odd] = c[odd] * np.exp(-r * (t_odd - b + 1))
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[owner])
        _, firsts = np.unique(owner[at], return_index=True)
        at = at[firsts]
        t = t_plain[low[at]]
        if len(odd):
            where = np.searchsorted(odd, at)
            hit = (where < len(odd)) & (odd[np.minimum(where, len(odd) - 1)] == at)
            t[hit] = t_odd[where[hit]]
        out[some, k] = mix(shingles[at] ^ mix(t.astype(np.int64).astype(U) + U(first + k)))
    return out


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(found), bands), U)
    for k in range(rows):
        keys = mix(keys + found[:, k::rows])
    return keys


def sketch(found: np.ndarray) -> np.ndarray:
    """The low bytes of the first samples, eight in a 64-bit word."""
    low = np.zeros((len(found), 8 * len(WORDS)), np.uint8)
    low[:, :SKETCHED] = found[:, :SKETCHED].astype(np.uint8)
    return low.view("<i8")


def agreeing(one: list[Column], two: list[Column]) -> Column:
    """How many of the sketched samples agree: zero bytes of the words' differences."""
    differ = F.lit(0)
    for x, y in zip(one, two, strict=True):
        d = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(SKETCHED) - differ


class Weights:
    """tf * idf of shingles; only the common ones are listed."""

    def __init__(self, common: np.ndarray, df: np.ndarray, documents: int, floor: float):
        order = np.argsort(common)
        self.common = common[order]
        self.idf = 1 + np.log(1 / np.maximum(df[order] / max(1, documents), floor))
        self.plain = 1 + math.log(1 / floor)

    def __call__(self, shingles: np.ndarray, tf: np.ndarray) -> np.ndarray:
        out = tf * self.plain
        if len(self.common):
            at = np.searchsorted(self.common, shingles)
            at[at == len(self.common)] = 0
            hit = self.common[at] == shingles
            out[hit] = tf[hit] * self.idf[at[hit]]
        return out


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _shingled(docs: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on an iterator over lists of encoded texts of about a megabyte; it yields Arrow batches."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        for batch in batches:
            for start, end in runs(batch.column(0)):
                raw = [t.encode() for t in batch.column(0).slice(start, end - start).to_pylist()]
                for a, b in parted(raw):
                    yield raw[a:b]

    return map_arrow(docs, lambda batches: work(parts(batches)), schema)


def _counts_batch(s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_as_long(s)), pa.array(n.astype(np.int64))], names=["shingle", "n"])


def document_frequencies(docs: DataFrame, text: str, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(Shingles in ``floor`` of the documents or more, their document frequencies, documents)."""
    texts = docs.select(text_or_empty(F.col(text)).alias("__text"))

    def report(parts: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
        held, size, members = [], 0, 0

        def often() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > floor / 2 * members
            return _counts_batch(s[some], n[some])

        for part in parts:
            held.append(vectors(part)[0])
            size += len(held[-1])
            members += len(part)
            if size >= HELD:
                yield often()
                held, size, members = [], 0, 0
        if held:
            yield often()

    documents = docs.count()
    reported = _shingled(texts, report, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= floor / 2 * documents)
    listed = np.array([r[0] for r in reported.select("shingle").collect()], np.int64)
    if not len(listed):
        return np.zeros(0, U), np.zeros(0, np.int64), documents
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(listed.view(U)))

    def count(parts: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        total = np.zeros(len(common), np.int64)
        for part in parts:
            s = vectors(part)[0]
            at = np.searchsorted(common, s)
            at[at == len(common)] = 0
            total += np.bincount(at[common[at] == s], minlength=len(common))
        yield _counts_batch(common[total > 0], total[total > 0])

    rows = _shingled(texts, count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= floor * documents).collect()
    shared.destroy()
    return np.array([r[0] for r in rows], np.int64).view(U), np.array([r[1] for r in rows], np.int64), documents


def identity(shingles: np.ndarray, tf: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over a text's shingles and their counts."""
    each = mix(shingles ^ mix(tf.astype(U)))
    upto = np.concatenate([[0], np.cumsum(counts)])
    one, two = (np.concatenate([[U(0)], np.cumsum(x, dtype=U)]) for x in (each, mix(each + U(1))))
    return one[upto[1:]] - one[upto[:-1]], two[upto[1:]] - two[upto[:-1]]


def weighted_jaccard(a: bytes, b: bytes, weights: Weights) -> float:
    s, tf, counts = vectors([a, b])
    n = counts[0]
    if not counts.all():
        return 0.0
    wa, wb = weights(s[:n], tf[:n]), weights(s[n:], tf[n:])
    _, i, j = np.intersect1d(s[:n], s[n:], assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def near_in_block(xs: list[str], x_labels: np.ndarray, ys: list[str], y_labels: np.ndarray, weights: Weights, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``xs`` and ``ys`` of all pairs of different labels that reach the threshold.

    A shingle that occurs n times counts as n features of its idf each, so the
    lesser weight of two texts is the sum over the features they share.
    """

    def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, tf, counts = vectors([t.encode() for t in texts])
        owner = np.repeat(np.arange(len(texts)), counts)
        idf = weights(s, np.ones(len(s)))
        nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        return mix(np.repeat(s, tf) + nth.astype(U)), np.repeat(idf, tf), np.repeat(owner, tf)

    key, idf, owner = features(xs)
    total = np.bincount(owner, idf, len(xs))
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    y_key, y_idf, y_owner = features(ys)
    ends = np.searchsorted(y_owner, np.arange(len(ys) + 1))
    low, high = np.searchsorted(key, y_key), np.searchsorted(key, y_key, "right")
    ones, twos = [], []
    for j in range(len(ys)):
        part = slice(ends[j], ends[j + 1])
        n = high[part] - low[part]
        at = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], np.repeat(y_idf[part], n), len(xs))
        near = (both >= threshold * (total + y_idf[part].sum() - both)) & (both > 0) & (x_labels != y_labels[j])
        ones.append(np.flatnonzero(near))
        twos.append(np.full(near.sum(), j))
    return (np.concatenate(ones), np.concatenate(twos)) if ones else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spanning(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same components, no more of them than nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    keep = np.zeros(len(one), bool)
    for k, (a, b) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[a], keep[k] = b, True
    return one[keep], two[keep]


def _similar(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts reach the threshold."""
    total = pairs.count()
    sided = pairs
    for side in ("a", "b"):
        sizes = pairs.groupBy(side).agg(F.count("*").alias("__n"))
        own = texts.select(F.col("__node").alias(side), F.col("__text").alias(f"__{side}")).join(sizes, side)
        sided = salted_join(sided, own, [side], "__n", F.struct("a", "b"), total=total).drop("__n")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            alike = [weighted_jaccard(x.encode(), y.encode(), w) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array(alike, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return map_arrow(sided.select("a", "b", "__a", "__b"), judge, "a long, b long")


def _members(keyed: DataFrame) -> DataFrame:
    """(bucket, node, sketch, n, met) of classes that share a bucket: its size, and the sizes of all the class's buckets."""
    bucket = keyed.select("__node", *WORDS, F.posexplode("__keys").alias("__band", "__key")).select("__node", *WORDS, F.xxhash64("__band", "__key").alias("__bucket"))
    crowded = written(bucket.groupBy("__bucket").agg(F.count("*").alias("__n")).where("__n > 1"), "crowded")
    found = salted_join(bucket, crowded, ["__bucket"], "__n", F.col("__node"))
    return written(found.withColumn("__met", F.sum("__n").over(W.partitionBy("__node"))), "members")


def _alike(a: str, b: str, least: int) -> Column:
    return agreeing([F.col(f"{a}.{w}") for w in WORDS], [F.col(f"{b}.{w}") for w in WORDS]) >= least


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class _Linker:
    """Finds the links among classes; see the module's text for the rounds."""

    def __init__(self, classes: DataFrame, texts_of, weights, threshold: float):
        self.classes, self.texts_of, self.weights, self.threshold = classes, texts_of, weights, threshold
        # of two classes at the threshold, fewer samples than this agree once in 100,000 times
        self.least = math.floor(SKETCHED * threshold - 4.2 * math.sqrt(SKETCHED * threshold * (1 - threshold)))
        self.checked: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def compare(self, pairs: DataFrame, texts: DataFrame) -> None:
        """Find the links among the pairs that weren't compared before; labels follow."""
        pairs = pairs.distinct()
        for done in self.checked:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.checked.append(pairs)
        found = written(_similar(pairs, texts, self.weights, self.threshold), "found")
        if not found.isEmpty():
            self.links.append(found)
            self.labels = components(functools.reduce(DataFrame.unionByName, self.links))

    def link(self, members: DataFrame) -> None:
        """Compare the members of buckets, those of crowds to the end."""
        texts = self.texts_of(members.select("__node").distinct())
        small, large = members.where(F.col("__n") <= SMALL), members.where(F.col("__n") > SMALL)
        met = small.alias("x").join(small.alias("y"), "__bucket").where((F.col("x.__node") < F.col("y.__node")) & _alike("x", "y", self.least))
        pairs = met.select(*_ordered(F.col("x.__node"), F.col("y.__node")))
        first = F.max_by(F.struct(F.col("__node").alias("__pivot"), *WORDS), F.struct("__met", F.xxhash64("__node")))
        heads = written(large.groupBy("__bucket").agg(F.count("*").alias("__size"), first.alias("y")), "heads")
        crowds = not heads.isEmpty()
        if crowds:
            held = salted_join(large.alias("x"), heads, ["__bucket"], "__size", F.col("__node"))
            held = held.where((F.col("__node") != F.col("y.__pivot")) & (agreeing([F.col(w) for w in WORDS], [F.col(f"y.{w}") for w in WORDS]) >= self.least))
            pairs = pairs.unionByName(held.select(*_ordered(F.col("__node"), F.col("y.__pivot"))))
        self.compare(pairs, texts)
        if not crowds:
            return
        # a crowd: a pivot's component and what shares a bucket with the pivot; its rest: what isn't in the component
        named, at_head = large.withColumn("__label", F.col("__node")), heads.select("__bucket", "__size", F.col("y.__pivot").alias("__head"))
        if self.labels is not None:
            named = large.join(self.labels.withColumnRenamed("node", "__node"), "__node", "left").withColumn("__label", F.coalesce("label", "__node")).drop("label")
            at_head = at_head.join(self.labels.select(F.col("node").alias("__head"), "label"), "__head", "left").withColumn("__head", F.coalesce("label", "__head")).drop("label")
        placed = salted_join(named.select("__bucket", "__node", "__label"), at_head, ["__bucket"], "__size", F.col("__node"))
        placed = written(placed.select("__head", "__node", "__label").distinct(), "crowds")
        sizes = placed.groupBy("__head").agg(F.count("*").alias("__n"), F.count_if(F.col("__label") != F.col("__head")).alias("__rest")).where("__rest > 0")
        self.blocks(placed, written(sizes, "rests"), texts)

    def blocks(self, placed: DataFrame, sizes: DataFrame, texts: DataFrame) -> None:
        """Compare the rest of each crowd with the crowd, in blocks."""
        if sizes.isEmpty():
            return
        weights, threshold = self.weights, self.threshold
        sized = salted_join(placed, sizes, ["__head"], "__n", F.col("__node"))
        rows, columns = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("__n", "__rest"))
        dealt = [F.pmod(F.xxhash64("__node", F.lit(side)), n).cast("int") for side, n in ((0, rows), (1, columns))]
        every = [F.explode(F.sequence(F.lit(0), n - 1)) for n in (rows, columns)]
        place = ["__head", "__row", "__column"]
        own = sized.withColumn("__row", dealt[0]).withColumn("__column", every[1])
        rest = sized.where(F.col("__label") != F.col("__head")).withColumn("__column", dealt[1]).withColumn("__row", every[0])
        own, rest = (x.select(*place, "__node", "__label").join(texts, "__node") for x in (own, rest))

        rest = rest.toDF(*(f"{c}y" for c in rest.columns))

        def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            y.columns = [c[:-1] for c in y.columns]
            found = near_in_block(x["__text"].tolist(), x["__label"].to_numpy(), y["__text"].tolist(), y["__label"].to_numpy(), weights.value, threshold)
            one, two = spanning(x["__node"].to_numpy()[found[0]], y["__node"].to_numpy()[found[1]])
            return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})

        found = own.groupBy(*place).cogroup(rest.groupBy(*(f"{c}y" for c in place))).applyInPandas(compare, "a long, b long").distinct()
        found = written(found, "found")
        if not found.isEmpty():
            self.links.append(found)
            self.labels = components(functools.reduce(DataFrame.unionByName, self.links))


def near_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = 0.8, floor: float = 0.01) -> DataFrame:
    """One row per document: ``key``, class_id (least key of its group), group_size, kept, text_hash.

    ``key`` is an integer. text_hash is the 64-bit hash of the text that, with
    the key, tells rows apart.
    """
    spark = docs.sparkSession
    common, df, documents = document_frequencies(docs, text, floor)
    weights = spark.sparkContext.broadcast(Weights(common, df, documents, floor))

    def sampler():
        w = weights.value

        def work(texts: list[str]) -> list[list]:
            raw = [t.encode() for t in texts]
            one, two, keys, words = [], [], [], []
            for a, b in parted(raw):
                s, tf, counts = vectors(raw[a:b])
                found = samples(s, w(s, tf), counts, BANDS * ROWS, w.plain)
                keys += [row if n else None for n, row in zip(counts.tolist(), _as_long(band_keys(found, BANDS, ROWS)).tolist(), strict=True)]
                x, y = identity(s, tf, counts)
                one += [v if n else None for n, v in zip(counts.tolist(), _as_long(x).tolist(), strict=True)]
                two += _as_long(y).tolist()
                words.append(sketch(found))
            return [one, two, keys, *(np.concatenate(words).T.tolist() if words else [[]] * len(WORDS))]

        return work

    many = T.ArrayType(T.LongType())
    source = docs.select(F.col(key).cast("long").alias("__id"), text_or_empty(F.col(text)).alias("__text")).withColumn("__fp", fingerprint(F.col("__text")))
    fields = [("__v1", T.LongType()), ("__v2", T.LongType()), ("__keys", many), *((w, T.LongType()) for w in WORDS)]
    signed = written(add_columns(source, "__text", fields, sampler, keep=["__id", "__fp"]), "signatures")
    order = F.struct(F.col("__id").isNull().alias("none"), "__id", "__fp")
    # a class is the documents with the same weighted shingles
    classes = signed.where("__v1 is not null").groupBy("__v1", "__v2").agg(F.min(order).alias("__least"), F.count("*").alias("__copies"), *(F.first(c).alias(c) for c in ("__keys", *WORDS)))
    classes = written(classes.withColumn("__node", F.monotonically_increasing_id()), "classes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(__node, __text) of classes, by the row that comes first in each."""
        firsts = classes.join(nodes, "__node", "left_semi").select("__node", F.col("__least.__id").alias("__i"), F.col("__least.__fp").alias("__f"))
        found = source.join(firsts, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__fp") == F.col("__f")))
        return written(found.select("__node", "__text").dropDuplicates(["__node"]), "texts")

    linker = _Linker(classes, texts_of, weights, threshold)
    members = _members(classes)
    if not members.isEmpty():
        linker.link(members)
    named = classes.select("__v1", "__v2", "__least", "__copies", F.col("__node").alias("__label"))
    if linker.labels is not None:
        named = classes.join(linker.labels.withColumnRenamed("node", "__node"), "__node", "left").select("__v1", "__v2", "__least", "__copies", F.coalesce("label", "__node").alias("__label"))
    groups = named.groupBy("__label").agg(F.min("__least").alias("__head"), F.sum("__copies").alias("group_size"), F.count("*").alias("__classes")).where("group_size > 1")
    # a group's classes are no more than its rows
    several = written(salted_join(named, groups, ["__label"], "__classes", F.col("__v1"), total=documents).select("__v1", "__v2", "__copies", "group_size", "__head"), "groups")
    out = salted_join(signed.select("__id", "__fp", "__v1", "__v2"), several, ["__v1", "__v2"], "__copies", F.struct("__id", "__fp"), total=documents, how="left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("__id").alias(key),
        F.when(alone, F.col("__id")).otherwise(F.col("__head.__id")).alias("class_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__id").eqNullSafe(F.col("__head.__id")) & (F.col("__fp") == F.col("__head.__fp")))).alias("kept"),
        F.col("__fp").alias("text_hash"),
    )
