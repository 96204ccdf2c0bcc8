from quillspark.streaming import events as ev

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    path = f"{DATA}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(DATA)
    q = ev.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT window_start, event_type, n FROM counts").collect()}
    assert got == {(r.window_start, r.event_type, r.n) for r in ev.windowed_counts(batch).collect()}


def test_revision_log(spark, tmp_path):
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(DATA)
    ev.latest_revisions(stream.select("user_id", "event_id", "event_type"), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/log").count() == spark.read.parquet(f"{DATA}/events.parquet").count()
