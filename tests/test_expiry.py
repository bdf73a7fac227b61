"""Streams whose state expires against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindrift.streaming import expiry
from spindrift.streaming import state as S

DAY = dt.datetime(2024, 1, 1)
GAP = 3600


@pytest.fixture
def files(spark, tmp_path):
    """Four files of events, two days apart from the third on; users 1 and 2 go on, 3 is quiet after the first file."""
    def rows(first, last, users):
        return [(n, u, "error" if n % 3 else "purchase", DAY + dt.timedelta(seconds=n * 400 + (u == 2) * (n // 4) * 3600)) for n in range(first, last) for u in users]

    parts = [rows(0, 6, (1, 2, 3)), rows(6, 12, (1, 2)), [(100, 1, "view", DAY + dt.timedelta(days=2)), (101, 4, "view", DAY + dt.timedelta(days=2))], [(200, 4, "error", DAY + dt.timedelta(days=2, seconds=60))]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "event_id long, user_id long, event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    return f"{tmp_path}/in", [r for p in parts for r in p]


def run(spark, stream, path):
    """All rows of the stream by trigger, and the state rows after each."""
    seen, kept = [], []
    q = stream.writeStream.outputMode("update").option("checkpointLocation", path).foreachBatch(lambda df, i: seen.extend((i, r) for r in df.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    for p in q.recentProgress:
        kept += [o["numRowsTotal"] for o in p["stateOperators"]]
    return seen, kept


def read(spark, path):
    return spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_last_entries(spark, files, tmp_path):
    expiry.use_rocksdb(spark)
    path, rows = files
    seen, kept = run(spark, expiry.last_entries(read(spark, path), "user_id", "ts", ["event_id"], ["event_id", "event_type"], 3, GAP), f"{tmp_path}/c1")
    last = {r.user_id: [tuple(e) for e in r.entries] for _, r in seen if not r.expired}
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp")
    want = {r.user_id: [tuple(e) for e in r.entries] for r in expiry.last_entries_of(table, "user_id", "ts", ["event_id"], ["event_id", "event_type"], 3, GAP).collect()}
    assert last == want and len(want[2]) < 4 and [e[0] for e in want[1]] == [100] and [e[0] for e in want[4]] == [101, 200]
    assert {r.user_id for _, r in seen if r.expired} >= {2, 3}
    assert kept[-1] < max(kept)  # what was quiet is gone


def test_states(spark, files, tmp_path):
    expiry.use_rocksdb(spark)
    path, rows = files
    start, schema = S.JOB
    seen, kept = run(spark, expiry.states(read(spark, path), "user_id", "ts", ["event_id"], start, S.job, schema, GAP), f"{tmp_path}/c2")
    last = {r.user_id: tuple(r)[:-1] for _, r in seen if not r.expired}
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp")
    recent = expiry.since_quiet(table, "user_id", "ts", ["event_id"], GAP)
    want = {r.user_id: tuple(r) for r in S.fold(recent.select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"], start, S.job, schema).collect()}
    assert last == want
    assert {r.user_id for _, r in seen if r.expired} >= {2, 3} and kept[-1] < max(kept)
