"""Batch forms of the streaming operators over the events table; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spindrift.functions import rules
from spindrift.plans.registry import query
from spindrift.session import table
from spindrift.streaming import expiry, windows
from spindrift.streaming import state as S


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


_W = "WINDOW s AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), l AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"


@query("rate_limit", f"SELECT event_id, user_id, count(*) OVER s AS recent, CASE WHEN count(*) OVER l > 5 OR round(sum(value) OVER l, 6) > 400 THEN 'reject' WHEN count(*) OVER s > 1 OR round(sum(value) OVER s, 6) > 150 THEN 'wait' ELSE 'admit' END AS decision FROM events {_W}")
def rate_limit(spark, sf_dir):
    """Decision on each request, with an hour and a day as windows."""
    return windows.limits(events(spark, sf_dir), 3600, 86_400, (1, 150), (5, 400))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    """Counts by six hours and type."""
    return windows.counts(events(spark, sf_dir), "6 hours")


@query("sliding_windows", "SELECT time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    """Counts by days that begin every twelve hours."""
    return windows.counts(events(spark, sf_dir), "24 hours", "12 hours")


@query("sessions", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 24 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, k")
def sessions(spark, sf_dir):
    """Sessions that end after a day without events."""
    return windows.sessions(events(spark, sf_dir))


@query("reputation", """WITH RECURSIVE o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 1000::BIGINT AS trust, 0::BIGINT AS violations, 0::BIGINT AS successes, 0::BIGINT AS blocked FROM events
UNION ALL SELECT f.user_id, o.i, CASE WHEN event_type = 'error' THEN greatest(0, trust - 100 - 50 * (violations + 1)) ELSE least(1000, trust + CASE WHEN violations > 0 THEN 5 ELSE 10 END) END, violations + (event_type = 'error')::BIGINT, successes + (event_type <> 'error')::BIGINT, CASE WHEN event_type <> 'error' THEN blocked WHEN violations + 1 >= 5 THEN least(1440, 5 * (2 ** least(violations + 1 - 5, 20))::BIGINT) ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, max_by(trust, i) AS trust, max_by(violations, i) AS violations, max_by(successes, i) AS successes, max_by(blocked, i) AS blocked_minutes, max_by(trust, i) > 700 AND max_by(violations, i) < 3 AS trusted FROM f GROUP BY user_id""")
def reputation(spark, sf_dir):
    """Trust of each user after its last event."""
    start, schema = S.REPUTATION
    found = S.fold(events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"], start, S.reputation, schema)
    return found.withColumn("trusted", (F.col("trust") > 700) & (F.col("violations") < 3))


@query("secure_gate", """WITH v AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad, max(ts) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_bad FROM events)
SELECT event_id, CASE WHEN bad >= 5 AND ts < last_bad + to_minutes(least(1440, 5 * (2 ** least(bad - 5, 20))::BIGINT)::INT) THEN 'blocked' WHEN event_type = 'error' THEN 'violation' ELSE 'answered' END AS outcome FROM v""")
def secure_gate(spark, sf_dir):
    """Blocked users are refused, violations recorded, others answered."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    wrong = F.col("event_type") == "error"
    v = events(spark, sf_dir).withColumn("bad", F.count_if(wrong).over(w)).withColumn("last_bad", F.max(F.when(wrong, F.col("ts"))).over(w))
    minutes = F.least(F.lit(1440), 5 * F.pow(F.lit(2), F.least(F.greatest(F.col("bad") - 5, F.lit(0)), F.lit(20)))).cast("int")
    blocked = (F.col("bad") >= 5) & (F.col("ts") < F.col("last_bad") + F.make_dt_interval(mins=minutes))
    return v.select("event_id", F.when(blocked, "blocked").when(wrong, "violation").otherwise("answered").alias("outcome"))


@query("token_bucket")
def token_bucket(spark, sf_dir):
    """What a token bucket admits of each user's events."""
    start, schema = S.BUCKET
    rows = S.timed(events(spark, sf_dir)).select("user_id", "at_us", "event_id")
    return S.fold(rows, "user_id", ["at_us", "event_id"], start, S.token_bucket, schema).select("user_id", F.round("tokens", 6).alias("tokens"), "admitted", "refused")


@query("ingest_jobs", """WITH RECURSIVE o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'pending' AS status, 0::BIGINT AS retries, 0::BIGINT AS delay FROM events
UNION ALL SELECT f.user_id, o.i, CASE WHEN status IN ('completed', 'failed') THEN status WHEN event_type = 'error' THEN CASE WHEN retries >= 3 THEN 'failed' ELSE 'retrying' END WHEN event_type = 'purchase' THEN 'completed' ELSE 'running' END, CASE WHEN status NOT IN ('completed', 'failed') AND event_type = 'error' AND retries < 3 THEN retries + 1 ELSE retries END, CASE WHEN status IN ('completed', 'failed') THEN delay WHEN event_type = 'error' AND retries < 3 THEN (2 ** (retries + 1))::BIGINT ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, max_by(status, i) AS status, max_by(retries, i) AS retries, max_by(delay, i) AS delay_s FROM f GROUP BY user_id""")
def ingest_jobs(spark, sf_dir):
    """Job of each user after its last event."""
    start, schema = S.JOB
    return S.fold(events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"], start, S.job, schema)


@query("job_cleanup", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'error') AND ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def job_cleanup(spark, sf_dir):
    """Ended jobs that are older than a day."""
    e = events(spark, sf_dir)
    last = F.broadcast(e.agg(F.max("ts").alias("last")))  # one row
    old = F.col("ts") < F.col("last") - F.expr("INTERVAL 24 HOURS")
    return e.where(F.col("event_type").isin("purchase", "error")).join(last, old).select("event_id")


@query("retry_backoff", "SELECT event_id, least(60.0::DOUBLE, 1.0 * 2.0 ** (event_id % 8)) AS delay_s, least(60.0::DOUBLE, 1.0 * 2.0 ** (event_id % 8)) * 0.5 AS least_s FROM events")
def retry_backoff(spark, sf_dir):
    """Delay before each retry, and its least by jitter."""
    d = rules.retry_delay(F.col("event_id") % 8)
    return events(spark, sf_dir).select("event_id", d.alias("delay_s"), (d * 0.5).alias("least_s"))


@query("recent_events", """WITH g AS (SELECT *, coalesce((epoch_us(ts) >= lag(epoch_us(ts)) OVER w + 172800000000)::INT, 0) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS span FROM g), l AS (SELECT *, max(span) OVER (PARTITION BY user_id) AS last FROM s)
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS events FROM (SELECT * FROM l WHERE span = last QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5) GROUP BY user_id""")
def recent_events(spark, sf_dir):
    """Last five events of each user since it was quiet for two days: the batch form of state that expires."""
    found = expiry.last_entries_of(events(spark, sf_dir), "user_id", "ts", ["event_id"], ["event_id"], 5, 2 * 86_400)
    return found.select("user_id", F.array_join("entries.event_id", ",").alias("events"))
