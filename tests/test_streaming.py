from pyspark.sql import functions as F

from evigrain.operators.ordered import project
from evigrain.streaming import events as se

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = se.projecting(stream, ["user_id"], "event_type", "value", "event_id", str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: seen.append(df))
    q.awaitTermination()
    want = sorted(map(tuple, project(e, ["user_id"], "event_type", "value", "event_id").collect()))
    assert sorted(map(tuple, seen[-1].collect())) == want


def test_dedup_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id")
    e.unionAll(e.limit(50)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = se.deduplicated(stream, ["event_id"], "ts").writeStream.format("memory").queryName("dedup_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup_out").count() == e.count()
    assert se.windowed_counts(stream, "ts", ["user_id"]).isStreaming
    closed = spark.createDataFrame([(1, "2024-01-01")], "user_id long, c string").select("user_id", F.to_timestamp("c").alias("closed_at"))
    assert se.until_closed(e, closed, "user_id", "ts").where("user_id = 1").count() == 0
