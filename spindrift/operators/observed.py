"""Counts and times of the stages of a plan, gathered while its one action runs: nothing is computed twice for them."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "trace string, place int, stage string, rows long, nulls map<string,long>, measure double, started string, seconds double"


class Trace:
    """Stages of one plan by name. `stage` marks a DataFrame; `run` is around the action; `rows` are then a row for each stage.

    A stage's numbers are those of the whole action, so `seconds` is the action's and the same for all of its stages: Spark runs the stages interleaved. A stage that the plan
    holds twice, or whose tasks ran again after an executor was lost, may be counted more than once. A stage that the optimizer removes, or that no action reached, has null counts.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.stages: list[tuple[str, Observation, list[str], bool]] = []
        self.started, self.seconds = None, None

    def stage(self, name: str, rows: DataFrame, nulls: tuple[str, ...] = (), measure=None) -> DataFrame:
        """`rows`, observed: their number, the nulls in some columns, and the sum of a measure, if one is given."""
        seen = Observation()
        counts = [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(nulls)]
        total = [F.sum(measure.cast("double")).alias("measure")] if measure is not None else []
        self.stages.append((name, seen, list(nulls), measure is not None))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts, *total)

    @contextmanager
    def run(self):
        """Around the one action."""
        self.started, begun = datetime.now(UTC).isoformat(timespec="milliseconds"), time.monotonic()
        try:
            yield self
        finally:
            self.seconds = time.monotonic() - begun

    def rows(self) -> DataFrame:
        """(trace, place, stage, rows, nulls, measure, started, seconds), a row for each stage, in the order in which they were marked. Not to be asked for before the action."""
        if self.seconds is None:
            raise ValueError("the action has not run")
        out = []
        for place, (name, seen, nulls, measured) in enumerate(self.stages, 1):
            got = seen.get
            out.append((self.label, place, name, got.get("rows"), {c: got.get(f"null_{i}") for i, c in enumerate(nulls)}, got.get("measure") if measured else None, self.started, self.seconds))
        return self.spark.createDataFrame(out, SCHEMA)

    def append(self, path: str) -> None:
        """Adds the stage rows to a folder of JSON lines."""
        self.rows().coalesce(1).write.mode("append").json(path)
