"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a Python worker holds in derived arrays at a time.
CHUNK_BYTES = 2_000_000
#: Bytes of an Arrow batch sent to a Python worker, unless one row has more.
BATCH_BYTES = 8_000_000
_TASK_CACHES: list = []


def task_cache(f: Callable) -> Callable:
    """Remember a function's results until the task of :func:`map_arrow` ends."""
    cached = functools.lru_cache(maxsize=64)(f)
    _TASK_CACHES.append(cached)
    return cached


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with bounded memory.

    Batches are held to :data:`BATCH_BYTES` by a session setting (a smaller one
    is left alone), and a worker, which outlives its tasks, gives back what a
    task has freed.
    """
    spark = df.sparkSession
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return free memory of a Python worker to the system."""
    for cached in _TASK_CACHES:
        cached.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables.

    The cluster's ``spark.checkpoint.dir`` wins, then a checkpoint folder set
    in code. Where neither is set, a temporary folder is made for a local
    master only: on a cluster executors wouldn't see each other's files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isDefined():
        return option.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="evigrain-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return scratch_dir(spark)


#: Tables written inside :func:`cleared`, innermost last.
_TRACKED: list[list[tuple[SparkSession, str]]] = []


def written(df: DataFrame, what: str, tracked: bool = True) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, read it back.

    Later stages read files that every executor sees, so a lost executor costs
    no recomputation of what came before. Only a ``tracked`` one is deleted by
    :func:`cleared`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/evigrain-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _TRACKED and tracked:
        _TRACKED[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleared() -> Iterator[None]:
    """Delete at the end all tables that :func:`written` made inside."""
    _TRACKED.append([])
    try:
        yield
    finally:
        for spark, path in _TRACKED.pop():
            _delete(spark, path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`written` made."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            _delete(df.sparkSession, name.rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def fingerprint(text: Column) -> Column:
    """With the key, tells rows apart whose key stands for several texts."""
    return F.xxhash64(text_or_empty(text))


def sampled(by: Column, share: float) -> Column:
    """Whether a row is in a sample of this share, by 63 bits of a hash of ``by``, so that any share of any corpus is met."""
    return F.lit(True) if share >= 1 else F.xxhash64(by).bitwiseAND(F.lit((1 << 63) - 1)) < min(int(share * (1 << 63)), (1 << 63) - 1)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, salt_by: Column, *, total: int | None = None, share: int = 500, least: int = 1000, how: str = "inner", shuffled: bool = False) -> DataFrame:
    """Join (inner or left) of many rows to one row per key that stays even under hot keys.

    ``right`` has unique ``keys`` and, in ``count``, how many rows of ``left``
    have that key; ``total`` is their sum or more, if that is known. Keys with
    more than one ``share``-th of those rows number fewer than ``share``,
    whatever the input, so the list of them is broadcast with that bound. Their
    left rows are dealt by ``salt_by`` over as many parts as keep a part to
    that share, and their right row is copied to each part. Where no key can
    have that many (``total`` up to ``least``) it is a plain join. ``shuffled``
    asks for a merge join whatever the sizes, where ``right`` grows with the
    input.
    """
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    hinted = (lambda df: df.hint("merge")) if shuffled else (lambda df: df)
    if total <= least:
        return left.join(hinted(right), list(keys), how)
    cutoff = max(total // share, least)
    parts = F.ceil(F.col(count) / cutoff).cast("int")
    hot = F.broadcast(right.where(F.col(count) > cutoff).select(*keys, parts.alias("__salts")))
    left = left.join(hot, list(keys), "left").withColumn("__salt", F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(salt_by), F.col("__salts"))).otherwise(F.lit(0)).cast("int")).drop("__salts")
    copies = F.when(F.col(count) > cutoff, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    right = right.withColumn("__salt", F.explode(copies))
    return left.join(hinted(right), [*keys, "__salt"], how).drop("__salt")


def add_columns(df: DataFrame, column: str, fields: Sequence[tuple[str, T.DataType]], make: Callable[[], Callable[[list], list[list]]], keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed from one column in Arrow batches.

    ``make()`` runs once a task and returns a function from a list of values
    to one list a field. ``keep`` names the input columns to pass on (all by
    default); an input column named as a new field gives way to it. Values are
    handed over in runs of about :data:`CHUNK_BYTES`, so what the function
    builds stays small whatever the batch.
    """
    new = {name for name, _ in fields}
    kept = [c for c in dict.fromkeys(df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t in fields)])
    arrow = to_arrow_schema(schema)
    source = "__value"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(source))
            for start, end in runs(values):
                out = work(values.slice(start, end - start).to_pylist())
                part = [batch.column(i).slice(start, end - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*(x.cast(arrow.field(i).type) for i, x in enumerate(part)), *(pa.array(x, arrow.field(len(kept) + i).type) for i, x in enumerate(out))], schema=arrow)

    return map_arrow(df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").alias(source)), run, schema)


def runs(values: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut an Arrow string or binary array into runs of about ``most`` bytes."""
    start, held = 0, 0
    sizes = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    import pyarrow.compute as pc

    for i, n in enumerate(pc.binary_length(sizes).fill_null(0).to_pylist()):
        held += n
        if held >= most or i - start >= 4095:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(values):
        yield start, len(values)
