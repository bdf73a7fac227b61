"""Streams give what the batch forms give on the same events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.streaming import state as S
from spindrift.streaming import windows

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, build, mode, name, parts=3):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / name)
    for i in range(parts):  # by time, so that nothing is late
        cut = events.withColumn("k", F.ntile(parts).over(Window.orderBy("ts", "event_id"))).where(F.col("k") == i + 1).drop("k")
        cut.coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(rows).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = streamed(spark, tmp_path, lambda e: windows.counts(e, "6 hours"), "update", "tumbling")
    last = got.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    assert rows(last, "start", "event_type", "n") == rows(windows.counts(events, "6 hours"), "start", "event_type", "n")


def test_sessions_that_ended(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = streamed(spark, tmp_path, lambda e: windows.sessions(e, "24 hours"), "append", "sessions_s")
    whole = set(rows(windows.sessions(events), "user_id", "start", "n"))
    assert got.count() > 0 and set(rows(got, "user_id", "start", "n")) <= whole


def test_state_machines(spark, tmp_path):
    events = S.timed(spark.read.parquet(f"{SF}/events.parquet"))
    for name, machine, step, order in (("reputation_s", S.REPUTATION, S.reputation, ["ts", "event_id"]), ("jobs_s", S.JOB, S.job, ["ts", "event_id"]), ("bucket_s", S.BUCKET, S.token_bucket, ["at_us", "event_id"])):
        start, schema = machine
        batch = S.fold(events, "user_id", order, start, step, schema)
        got = streamed(spark, tmp_path, lambda e, s=start, f=step, k=schema, o=order: S.stream(S.timed(e), "user_id", o, s, f, k), "update", name)
        counter = {"reputation_s": lambda r: r.violations + r.successes, "bucket_s": lambda r: r.admitted + r.refused}.get(name)
        seen = {}
        for r in got.collect():
            if counter is None or r.user_id not in seen or counter(r) >= counter(seen[r.user_id]):
                seen[r.user_id] = r
        assert sorted(tuple(r) for r in seen.values()) == sorted(tuple(r) for r in batch.collect())


def test_known_content(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    build = lambda e: windows.known_content(e.select("ts", F.col("event_type").alias("text")), "1000 hours").select("text")
    got = streamed(spark, tmp_path, build, "append", "known")
    assert rows(got, "text") == rows(events.select(F.col("event_type").alias("text")).distinct(), "text")
