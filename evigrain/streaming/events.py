"""Event logs as streams: idempotent append, windows, projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import project


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """One row per key; state older than the watermark is dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per key and tumbling window."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def until_closed(events: DataFrame, closed: DataFrame, by: str, time: str) -> DataFrame:
    """Events of runs that weren't closed yet; ``closed`` has the run and ``closed_at``."""
    out = events.join(closed, by, "left")
    return out.where(F.col("closed_at").isNull() | (F.col(time) <= F.col("closed_at"))).drop("closed_at")


def projecting(events: DataFrame, by: list[str], field: str, value: str, seq: str, path: str, checkpoint: str, done: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keep the last value of each field in a table that every batch replaces.

    A batch that is repeated after a failure gives the same table: the fold
    keeps the greatest ``seq``, so folding a batch twice changes nothing. Each
    version is written to a folder of its own, named by the batch.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = project(batch, by, field, value, seq)
        if number > 0:
            old = spark.read.parquet(f"{path}/v{number - 1}")
            new = old.unionByName(new).groupBy(*by, field).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        new.write.mode("overwrite").parquet(f"{path}/v{number}")
        if done:
            done(spark.read.parquet(f"{path}/v{number}"))

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
