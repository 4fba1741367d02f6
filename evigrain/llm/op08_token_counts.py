"""Token counts by a map-side two-tier lookup.

A piece vocabulary in which no piece holds a line break, or a space mark after
another character, never merges across those places. So a text falls apart into
pre-tokens (a run of spaces with the word after it, a bare word, a line break)
whose token counts add up to the text's.

* Tier 1: a broadcast table from frequent pre-tokens to their token counts. It
  has at most ``table_size`` entries of up to 48 characters, the most frequent
  of all documents by exact counts. It only saves work; results don't depend on it.
* Tier 2: a bounded cache in each Python worker for all other pre-tokens; those
  not there are encoded in one call a batch.

Pre-tokens are shuffled once as counts, one a task and pre-token; the rest is a
scan and one Arrow map.

Defined cases: null and empty texts have 0 tokens; a text of any length is
counted whole; every input row gives one row, repeated rows too; an empty table
gives an empty result; input columns other than those kept are dropped, and one
named as an output column gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, map_arrow, text_or_empty, written

SPACE_MARK = "▁"
PRE_TOKEN = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Longer pre-tokens are rare, and are not cached.
LONGEST_CACHED = 48
#: Different pre-tokens that a task counts before it sends them.
HELD = 500_000


def pre_tokens(text: str) -> list[str]:
    """Of a text as the library normalises it: a space goes before it, marks are spaces."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE_MARK, " ")) if text else []


def splits_safely(pieces: Sequence[str]) -> bool:
    """Whether no piece crosses a place where :func:`pre_tokens` cuts."""
    return not any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)


class PieceCounter:
    """Counts of pre-tokens: the broadcast table, then what the worker has met since."""

    def __init__(self, model: bytes, frequent: dict[str, int] | None = None, cache_size: int = 300_000):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.safe = splits_safely([self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size()) if not self.processor.is_byte(i)])
        self.frequent = frequent or {}
        self.known = dict(self.frequent)
        self.most = len(self.known) + cache_size

    def lengths(self, found: list[str]) -> list[int]:
        """A line break first keeps the library's own leading space off; it and that space are two tokens."""
        return [len(x) - 2 for x in self.processor.encode(["\n" + p for p in found], num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.processor.encode(texts, num_threads=1)]
        split = [pre_tokens(t) for t in texts]
        met = set().union(*split) if split else set()
        misses = list(met - self.known.keys())
        if len(self.known) + len(misses) > self.most:
            self.known = dict(self.frequent)
            misses = list(met - self.known.keys())
        now = dict(zip(misses, self.lengths(misses), strict=True))
        long = [p for p in misses if len(p) > LONGEST_CACHED]
        self.known.update(now)
        length = self.known.__getitem__
        out = [sum(map(length, found)) for found in split]
        for p in long:
            del self.known[p]
        if len(self.known) > self.most:
            self.known = dict(self.frequent)
        return out


_COUNTERS: dict = {}


def _counter(key, model: bytes, frequent: dict[str, int], cache_size: int) -> PieceCounter:
    """One for each worker process and call, so that tasks share the cache."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PieceCounter(model, frequent, cache_size)
    return _COUNTERS[key]


def frequent_pre_tokens(docs: DataFrame, text: str, table_size: int) -> list[str]:
    """The most frequent pre-tokens of all documents, by exact counts; a task holds and sends at most :data:`HELD` at a time."""
    texts = docs.select(text_or_empty(F.col(text)).alias("__text"))

    def sent(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["piece", "n"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(p for p in pre_tokens(t) if len(p) <= LONGEST_CACHED)
                if len(found) > HELD:
                    yield sent(found)
                    found = Counter()
        yield sent(found)

    counted = map_arrow(texts, seen, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counted = written(counted, "counts")
    # a row to the driver for each count that occurs, then only pre-tokens as frequent as fit; ties that don't are left out
    room, least = table_size, None
    for n, pieces in counted.groupBy("n").agg(F.count("*").alias("pieces")).orderBy(F.desc("n")).limit(table_size).collect():
        room -= pieces
        if room < 0:
            break
        least = n
    return [] if least is None else [r["piece"] for r in counted.where(F.col("n") >= least).select("piece").collect()]


def count_tokens(docs: DataFrame, model: bytes, *, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: int = 4096, table_size: int = 65_536, cache_size: int = 300_000) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row.

    ``model`` holds the bytes of a sentencepiece model file. See the module's
    text for the method and the defined cases.
    """
    spark = docs.sparkSession
    top = frequent_pre_tokens(docs, text, table_size)
    frequent = dict(zip(top, PieceCounter(model).lengths(top), strict=True))
    shared = spark.sparkContext.broadcast((model, frequent))
    key = (id(shared), hash(model), len(frequent))

    def make():
        model_, frequent_ = shared.value
        counter = _counter(key, model_, frequent_, cache_size)
        return lambda texts: [counter.count(texts)]

    kept = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*kept, text_or_empty(F.col(text)).alias("__text")).withColumn("n_bytes", F.octet_length("__text").cast("long"))
    counted = add_columns(rows, "__text", [("n_tokens", T.LongType())], make, keep=[*kept, "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
