"""Language identification: multinomial naive Bayes over hashed character n-grams.

The lower-cased text's UTF-8 bytes (runs of ASCII characters other than letters
become one space, which also stands at either end) give n-grams of 2 to 4
bytes, each hashed to one of ``buckets``. Training counts buckets for each
language in Arrow batches and adds the counts up in Spark, so that the driver
gets at most ``buckets`` rows a language. The log-probability matrix (buckets x
languages, 32-bit) is broadcast, and a batch's texts are scored together: the
rows of the matrix for all n-grams are gathered and summed text by text.

The classifier is fitted on about ``max_train_docs`` labelled rows at most,
picked by a hash of their id; everything is predicted on whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so
is every text if nothing was there to learn from; texts of any length are read
whole, in slices; of equal posteriors the alphabetically first language wins;
every input row gives one row; an empty table gives an empty result; input
columns other than those kept are dropped, and one named as an output column
gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, map_arrow, runs, sampled, text_or_empty

#: A character of Unicode category L.
LETTER = regex.compile(r"\p{L}")
SIZES = (2, 3, 4)
BUCKET_BITS = 16
#: Bytes scored in one go.
SLICE = 400_000
#: ASCII letters and all bytes of other characters stay, the rest is a space.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def folded(text: str) -> np.ndarray:
    raw = FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    return raw[keep]


def buckets_of(raw: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each n-gram of one size."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        h = (h ^ raw[k : n + k]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BUCKET_BITS)


def slices(raw: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Runs of a long text that overlap so that each n-gram is in one of them."""
    step = SLICE
    for start in range(0, max(1, len(raw) - size + 1), step):
        yield raw[start : start + step + size - 1]


def text_counts(text: str, into: np.ndarray) -> None:
    raw = folded(text)
    for size in SIZES:
        for part in slices(raw, size):
            into += np.bincount(buckets_of(part, size), minlength=len(into))


def train(docs: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", max_train_docs: int = 20_000, max_labels: int = 256, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(Languages, log-probability matrix) from the labelled rows of ``docs``.

    A label that is null isn't learned from. More than ``max_labels`` labels
    are refused, as the matrix that is broadcast grows with them. Priors are
    equal: what share of a corpus a language has says nothing about one text.
    """
    labelled = docs.where(F.col(label).isNotNull()).select(F.col(key).alias("__key"), text_or_empty(F.col(text)).alias("__text"), F.col(label).cast("string").alias("__label"))
    total = labelled.count()
    if total > max_train_docs:
        labelled = labelled.where(sampled(F.col("__key"), max_train_docs / total))
    width = 1 << BUCKET_BITS
    schema = "label string, bucket int, n long"

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, end in runs(batch.column(0)):
                for t, name in zip(batch.column(0).slice(start, end - start).to_pylist(), batch.column(1).slice(start, end - start).to_pylist(), strict=True):
                    if name not in held:
                        held[name] = np.zeros(width, np.int64)
                    text_counts(t, held[name])
        for name, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["label", "bucket", "n"])

    names = sorted(r[0] for r in labelled.select("__label").distinct().limit(max_labels + 1).collect())
    if len(names) > max_labels:
        raise ValueError(f"{label} has over {max_labels} values")
    counted = map_arrow(labelled.select("__text", "__label"), count, schema).groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    matrix = np.full((width, len(names)), smoothing)
    # one row a language with all its buckets
    for r in counted.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("all")).toLocalIterator():
        at = np.array(r["all"], np.int64).reshape(-1, 2)
        matrix[at[:, 0], names.index(r["label"])] += at[:, 1]
    return names, np.log(matrix / matrix.sum(0)).astype(np.float32)


def score(texts: list[str], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """The best language and its posterior for each text."""
    n = len(texts)
    known = np.array([bool(names) and LETTER.search(t) is not None for t in texts], bool)
    raws = [folded(t) if k else None for t, k in zip(texts, known, strict=True)]
    sums = np.zeros((n, len(names)))
    for size in SIZES:
        held: list[np.ndarray] = []
        owner: list[int] = []
        total = 0

        def add(size=size):
            # of a run that goes over two texts, the n-grams that do so are left out
            nonlocal held, owner, total
            if held:
                parts = [buckets_of(x, size) for x in held]
                lengths = np.array([len(p) for p in parts])
                some = lengths > 0
                if some.any():
                    rows = matrix[np.concatenate(parts)]
                    starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
                    np.add.at(sums, np.array(owner)[some], np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
            held, owner, total = [], [], 0

        for i, raw in enumerate(raws):
            if raw is None:
                continue
            for part in slices(raw, size):
                held.append(part)
                owner.append(i)
                total += len(part)
                if total >= SLICE:
                    add()
        add()
    labels, scores = ["und"] * n, [0.0] * n
    if names:
        best = sums.argmax(1)
        odds = np.exp(sums - sums.max(1, keepdims=True))
        top = 1 / odds.sum(1)
        for i in np.flatnonzero(known):
            labels[i], scores[i] = names[best[i]], float(top[i])
    return labels, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text", keep: Sequence[str] = ("doc_id",), label: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``keep`` columns, the language of each whole text and its posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        names, matrix = shared.value
        return lambda texts: list(score([t or "" for t in texts], names, matrix))

    fields = [(label, T.StringType()), (score_name, T.DoubleType())]
    kept = [c for c in keep if c not in (label, score_name)]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("__text"))
    return add_columns(rows, "__text", fields, make, keep=kept)


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is in the fold that nothing is learned from."""
    return F.crc32(key.cast("string").cast("binary")) % folds == 0
