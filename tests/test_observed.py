"""Stage rows come from the action itself."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators.observed import Trace


def test_stage_rows_equal_the_stages(spark, tmp_path):
    trace = Trace(spark, "t")
    base = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("id")))
    a = trace.stage("read", base, ("x",))
    b = trace.stage("kept", a.where("id % 3 = 0"), measure=F.col("id"))
    c = trace.stage("grouped", b.groupBy((F.col("id") % 10).alias("g")).agg(F.sum("x").alias("s")), ("g", "s"))
    with pytest.raises(ValueError):
        trace.rows()
    calls = spark.sparkContext.accumulator(0)

    def touch(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    with trace.run():
        c.mapInPandas(touch, "g long, s long").write.format("noop").mode("overwrite").save()
    got = {r.stage: r for r in trace.rows().collect()}
    assert [(r.place, r.rows) for r in sorted(got.values(), key=lambda r: r.place)] == [(1, 1000), (2, 334), (3, 10)]
    assert got["read"].nulls == {"x": 143} and got["read"].measure is None and got["kept"].measure == sum(range(0, 1000, 3))
    assert calls.value == 10  # one action
    assert all(r.seconds > 0 and r.trace == "t" for r in got.values())
    trace.append(str(tmp_path / "log"))
    trace.append(str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_empty_input(spark):
    trace = Trace(spark, "t")
    out = trace.stage("none", spark.range(0), ("id",), F.col("id"))
    with trace.run():
        assert out.collect() == []
    (r,) = trace.rows().collect()
    assert r.rows in (0, None) and not r.measure
