from pyspark.sql import functions as F

from folioscope.streaming import jobs, windows


def test_tumbling_stream_matches_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.parquet(str(tmp_path / "in/a"))
    stream = windows.event_stream(spark, str(tmp_path / "in/a"), events.schema)
    out = windows.tumbling(stream, "1 day", "60 days", ["event_type"], [F.count(F.lit(1)).alias("n")])
    q = out.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window.start, r.event_type): r.n for r in spark.table("tumbled").collect()}
    want = {(r.d, r.event_type): r.n for r in events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_job_stream_matches_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.col("event_id"))
    requests = jobs.requests_of_events(events).coalesce(1).sortWithinPartitions("seq")
    requests.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in")).select("job", "seq", "request")
    q = jobs.stream_states(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("states").collect()}
    assert got == {tuple(r) for r in jobs.final_states(requests).collect()}
