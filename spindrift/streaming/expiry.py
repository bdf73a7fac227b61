"""State of keys on a stream that ends by itself: the last entries of a key, or a state machine, until the key has been quiet for a while.

A key's state is dropped when an event comes a gap or more after the one before, and by a timer when the watermark has passed that point and no event came; the timer also puts out a last row, marked `expired`.
Both rules draw the same line, so what stands at the end is a function of the events, and the batch forms give it. Events later than the watermark are Spark's to drop. Needs the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Quiet(StatefulProcessor):
    """What both kinds share: one timer for each key, a gap after its last event."""

    def __init__(self, key: str, at: str, order: list[str], gap_s: int):
        self.key, self.at, self.order, self.gap_us = key, at, order, gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))
        self.open(handle)

    def events(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """A trigger's events of a key in order, with their time in microseconds."""
        f = pd.concat(list(rows))
        f["__us"] = f[self.at].astype("datetime64[us]").astype("int64")
        return f.sort_values(["__us", *self.order], kind="stable")

    def wait(self, us: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((us,))
        self.handle.registerTimer((us + self.gap_us) // 1000)

    def close(self) -> None:
        pass


class _Last(_Quiet):
    """The last `n` entries of a key, a list in the state store."""

    def __init__(self, key: str, at: str, order: list[str], columns: list[str], schema: StructType, n: int, gap_s: int):
        super().__init__(key, at, order, gap_s)
        self.columns, self.schema, self.n = columns, schema, n

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", self.schema)

    def row(self, key: tuple, entries: list[tuple], expired: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "entries": [[dict(zip(self.columns, e, strict=True)) for e in entries]], "expired": [expired]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        held = [tuple(e) for e in self.entries.get()] if self.entries.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        f = self.events(rows)
        for us, *entry in f[["__us", *self.columns]].astype(object).itertuples(index=False):
            held = held[1 - self.n :] if self.n > 1 and (last is None or us < last + self.gap_us) else []
            held, last = [*held, tuple(entry)], us
        self.entries.put(held)
        self.wait(int(last))
        yield self.row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.entries.clear()
        self.last.clear()
        yield self.row(key, [], True)


class _Step(_Quiet):
    """A state machine of a key; step(state, row) -> state."""

    def __init__(self, key: str, at: str, order: list[str], start: tuple, step: Callable, schema: StructType, gap_s: int):
        super().__init__(key, at, order, gap_s)
        self.start, self.step, self.schema = start, step, schema

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def row(self, key: tuple, state: tuple, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *state, expired)], columns=[self.key, *self.schema.names, "expired"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else self.start
        last = self.last.get()[0] if self.last.exists() else None
        for event in self.events(rows).rename(columns={"__us": "us"}).itertuples(index=False):
            state = self.step(state if last is None or event.us < last + self.gap_us else self.start, event)
            last = event.us
        state = tuple(x.item() if hasattr(x, "item") else x for x in state)
        self.state.update(state)
        self.wait(int(last))
        yield self.row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get())
        self.state.clear()
        self.last.clear()
        yield self.row(key, state, True)


def _kind(rows: DataFrame, key: str) -> str:
    return f"{key} {rows.schema[key].dataType.simpleString()}"


def last_entries(rows: DataFrame, key: str, at: str, order: list[str], columns: list[str], n: int, gap_s: int, delay: str = "0 seconds") -> DataFrame:
    """(key, entries, expired) on a stream: after each trigger a row for each key that it touched, with the key's last `n` entries (`columns`) since it was quiet for `gap_s` seconds."""
    schema = StructType([rows.schema[c] for c in columns])
    out = f"{_kind(rows, key)}, entries array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in schema)}>>, expired boolean"
    return rows.withWatermark(at, delay).groupBy(key).transformWithStateInPandas(_Last(key, at, order, columns, schema, n, gap_s), out, "Update", "EventTime")


def states(rows: DataFrame, key: str, at: str, order: list[str], start: tuple, step: Callable, schema: str, gap_s: int, delay: str = "0 seconds") -> DataFrame:
    """(key, state, expired) on a stream: after each trigger the state of each key that it touched; a key that was quiet for `gap_s` seconds starts anew."""
    out = f"{_kind(rows, key)}, {schema}, expired boolean"
    return rows.withWatermark(at, delay).groupBy(key).transformWithStateInPandas(_Step(key, at, order, start, step, StructType.fromDDL(schema), gap_s), out, "Update", "EventTime")


def since_quiet(rows: DataFrame, key: str, at: str, order: list[str], gap_s: int) -> DataFrame:
    """Batch form: the rows of each key since it was last quiet for `gap_s` seconds."""
    w = W.partitionBy(key).orderBy(at, *order)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    fresh = (us >= F.lag(us).over(w) + gap_s * 1_000_000).cast("int")
    spans = rows.withColumn("__fresh", F.coalesce(fresh, F.lit(0))).withColumn("__span", F.sum("__fresh").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return spans.withColumn("__last", F.max("__span").over(W.partitionBy(key))).where("__span = __last").drop("__fresh", "__span", "__last")


def last_entries_of(rows: DataFrame, key: str, at: str, order: list[str], columns: list[str], n: int, gap_s: int) -> DataFrame:
    """Batch form of last_entries: (key, entries), in order."""
    w = W.partitionBy(key).orderBy(F.col(at).desc(), *(F.col(c).desc() for c in order))
    kept = since_quiet(rows, key, at, order, gap_s).withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n)
    return kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__place")).alias("p"), F.struct(*columns).alias("e")))), lambda x: x["e"]).alias("entries"))  # n entries
