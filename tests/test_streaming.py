from pyspark.sql import functions as F

from tessera.streaming.replicates import event_stream, first_wins_stream, hourly

SMALL = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_hourly_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    batch.unionByName(batch.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = hourly(first_wins_stream(event_stream(spark, str(tmp_path / "in"), SCHEMA), "event_id", "ts", "60 days"), "event_type", "ts", "value", None)
    q = stream.writeStream.outputMode("update").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("hours").agg(F.sum("n").alias("n"), F.min("least").alias("least")).first()
    want = batch.agg(F.count("*").alias("n"), F.min("value").alias("least")).first()
    assert (got["n"], got["least"]) == (want["n"], want["least"])
