"""Per-key state machines, once for batches and streams: a step function takes the state and an event and gives the new state.

A batch sorts each partition by key and time and folds while it reads, with one state in memory. A stream keeps the
state of each key between triggers; its events of one trigger are sorted by time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fold(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable, schema: str) -> DataFrame:
    """(key, ...state) after each key's last event. step(state, row) -> state; schema: that of the state."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                k = getattr(row, key)
                if now != (k,):
                    if now:
                        out.append((*now, *state))
                    now, state = (k,), start
                state = step(state, row)
            yield pd.DataFrame(out, columns=[key, *names])
        if now:
            yield pd.DataFrame([(*now, *state)], columns=[key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{key} {kind}, {schema}")


def stream(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable, schema: str) -> DataFrame:
    """The same over a stream: a row for each key and trigger with its state so far."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(k, frames, held):
        state = held.get if held.exists else start
        events = pd.concat(list(frames)).sort_values(order, kind="stable")
        for row in events.itertuples(index=False):
            state = step(state, row)
        state = tuple(x.item() if hasattr(x, "item") else x for x in state)
        held.update(state)
        yield pd.DataFrame([(*k, *state)], columns=[key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", schema, "update", "NoTimeout")


REPUTATION = ((1000, 0, 0, 0), "trust long, violations long, successes long, blocked_minutes long")


def reputation(state: tuple, row) -> tuple:
    """Trust in thousandths. The n-th violation costs 100 + 50 n and from the fifth on blocks for 5, 10, 20 ... minutes, a day at most; a success earns 10, or 5 after any violation."""
    trust, bad, good, blocked = state
    if row.event_type == "error":
        bad += 1
        return max(0, trust - 100 - 50 * bad), bad, good, min(1440, 5 * 2 ** min(bad - 5, 20)) if bad >= 5 else 0
    return min(1000, trust + (5 if bad else 10)), bad, good + 1, blocked


BUCKET = ((10.0, 0, 0, -1), "tokens double, admitted long, refused long, last_us long")
RATE, BURST = 10.0 / 86_400, 10.0


def token_bucket(state: tuple, row) -> tuple:
    """Refilled with RATE tokens a second up to BURST; an event takes one or is refused."""
    tokens, admitted, refused, last = state
    now = int(row.at_us)
    if last >= 0:
        tokens = min(BURST, tokens + (now - last) / 1e6 * RATE)
    if tokens >= 1:
        return tokens - 1, admitted + 1, refused, now
    return tokens, admitted, refused + 1, now


JOB = (("pending", 0, 0), "status string, retries long, delay_s long")


def job(state: tuple, row) -> tuple:
    """An error retries after 2, 4 and 8 seconds, and the fourth fails; a purchase completes; anything else runs. Ended jobs stay."""
    status, retries, delay = state
    if status in ("completed", "failed"):
        return state
    if row.event_type == "error":
        return ("failed", retries, 0) if retries >= 3 else ("retrying", retries + 1, 2 ** (retries + 1))
    return ("completed", retries, 0) if row.event_type == "purchase" else ("running", retries, 0)


def timed(events: DataFrame) -> DataFrame:
    """Events with their time in microseconds."""
    return events.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
