"""Windows, sessions, limits and duplicates over events: each works on batches and, behind a watermark, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def late(events: DataFrame, delay: str) -> DataFrame:
    """`events` with a watermark if they stream; rows later than `delay` then drop out. A watermark wants instants, as the session's zone reads them."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def counts(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return late(events, delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, n, total) of each user's sessions, which end after a gap without events."""
    w = F.session_window("ts", gap)
    return late(events, delay).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def known_content(texts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows whose content was not seen before; a stream forgets what is older than the watermark."""
    hashed = texts.withColumn("hash", F.sha2("text", 256))
    return late(hashed, delay).dropDuplicatesWithinWatermark(["hash"]) if texts.isStreaming else hashed.dropDuplicates(["hash"])


def limits(events: DataFrame, short_s: int = 60, long_s: int = 3600, short: tuple = (60, 40_000), long: tuple = (3000, 1_000_000)) -> DataFrame:
    """Decision on each request: reject above the long window's requests or tokens, wait above the short one's, else admit. A window holds its boundary."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = lambda s: W.partitionBy("user_id").orderBy("at").rangeBetween(-s * 1_000_000, 0)
    rows = events.withColumn("at", at)
    n = lambda s: F.count(F.lit(1)).over(w(s))
    tokens = lambda s: F.round(F.sum("value").over(w(s)), 6)
    over = lambda s, most: (n(s) > most[0]) | (tokens(s) > most[1])
    return rows.select("event_id", "user_id", n(short_s).alias("recent"), F.when(over(long_s, long), "reject").when(over(short_s, short), "wait").otherwise("admit").alias("decision"))
