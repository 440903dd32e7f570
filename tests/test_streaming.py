from tidemark.streaming.activity import activity, run_once


def test_stream_equals_batch(spark, sf, tmp_path):
    log = spark.read.parquet(f"{sf}/events.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run_once(activity(stream, customer="user_id", timestamp="ts", late="60 days"), "daily", str(tmp_path / "state"))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, activity(log, customer="user_id", timestamp="ts").collect()))
