"""Embedding whitening: a RowMatrix Gramian over exactly centred rows, a local eigendecomposition, and a whitening map sent to every task.

Entries c become integers x = floor(1024 * c) + 100000. With S the sums of x by dimension over n vectors, a centred entry is x - S/n; it is
computed as (x - q) - r/n with S = q*n + r, so the large common offset leaves before any rounding, and products are of centred values only.

A vector that is null or holds a null or non-finite entry is left out, and so is one whose length is not that of most vectors (of equally frequent lengths the larger):
no covariance joins lengths. Entries beyond 2^43 after scaling count as 2^43. Rows are kept as they are: repeated vectors and ids count as often as they occur, null ids stay.
Components are numbered by falling variance; equal variances come in the order of the decomposition, and each component's sign makes its largest entry positive
(the first of equal ones). Directions without variance (below `RANK` of the largest) have no whitened form and are not returned, so equal vectors alone give no
row; neither does an empty table. Other columns are ignored. What reaches the driver is n, d sums and a d x d matrix, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.scratch import Scratch

#: Scale and offset of the integer entries; the largest scaled size; variances under this share of the largest are none.
SCALE, OFFSET, LARGEST, RANK = 1024, 100_000, 2.0**43, 1e-13


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, x) of the vectors that whitening is about: x as array<bigint>."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + OFFSET
    rows = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths.d if lengths else 0)).select("key", F.transform("v", whole).alias("x"))


def gramian(rows: DataFrame, column: Column, d: int) -> np.ndarray:
    """Sum of the outer products of array<double> rows, added up on the executors in a tree."""
    dense = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(dense, 0, d).computeGramianMatrix().toArray()


@dataclass(frozen=True)
class Fit:
    """n, the sums of x by dimension, unit components (a column each), their variances, and the sum of all variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float


def fit(rows: DataFrame, most: int) -> Fit:
    """Covariance of rows (x) with divisor n, and its first components."""
    n = rows.count()
    each = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    sums = tuple(int(r.s) for r in each.orderBy("at").collect())
    d = len(sums)
    if not d:
        return Fit(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    covariance = gramian(rows, _centred(n, sums), d) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values[-1], 0.0) * RANK]
    kept = vectors[:, order]
    kept = kept * np.where(kept[np.abs(kept).argmax(0), np.arange(kept.shape[1])] < 0, -1.0, 1.0)
    return Fit(n, sums, kept, values[order], float(np.trace(covariance)))


def _centred(n: int, sums: tuple[int, ...]) -> Column:
    """x - S/n, without the rounding that dividing S first would bring."""
    q = F.array(*(F.lit(s // n).cast("long") for s in sums))
    r = F.array(*(F.lit((s % n) / n) for s in sums))
    return F.zip_with(F.zip_with("x", q, lambda x, a: (x - a).cast("double")), r, lambda x, b: x - b)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2 of each row, exactly; None beyond the range of a long."""
    s = np.array(sums, dtype=object)
    most = max(abs(int(x.max()) * n - min(sums)), abs(int(x.min()) * n - max(sums))) if x.size else 0
    if most * most * max(x.shape[1], 1) < 1 << 63:
        away = x * n - s.astype(np.int64)
        return (away * away).sum(1).tolist()
    away = x.astype(object) * n - s
    return [v if v < 1 << 63 else None for v in (away * away).sum(1).tolist()]


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, Fit, float | None]:
    """(key, deviation, whitened array) of each remaining vector, the fit, and the largest entry of the whitened vectors' covariance less the identity."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.save(integers(vectors, key, column))
    known = fit(rows, components)
    n, sums, d = known.n, known.sums, len(known.sums)
    turn = known.components / np.sqrt(known.variances)
    q, r = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, d), np.int64)
            away = (x - q).astype(np.float64) - r
            yield pd.DataFrame({"key": b["key"], "deviation": pd.array(deviations(x, n, sums), "Int64"), "whitened": list(away @ turn)})

    schema = f"key {rows.schema['key'].dataType.simpleString()}, deviation long, whitened array<double>"
    if not known.components.size:
        return vectors.sparkSession.createDataFrame([], schema), known, None
    made = scratch.save(rows.mapInPandas(run, schema))
    k = turn.shape[1]
    means = [m.m for m in made.select(F.posexplode("whitened").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("m")).orderBy("at").collect()]
    centre = F.array(*(F.lit(m) for m in means))
    off = gramian(made, F.zip_with("whitened", centre, lambda w, m: w - m), k) / n - np.eye(k)
    return made, known, float(np.abs(off).max())


def by_component(vectors: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component: key, component from 1, n, deviation, whitened, explained share, identity_error."""
    made, known, error = whiten(vectors, components, key, column)
    explained = F.array(*(F.lit(float(v / known.total)) for v in known.variances)) if known.variances.size else F.array().cast("array<double>")
    each = made.select("key", "deviation", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("at", "w"))
    return each.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(known.n).cast("long").alias("n"), "deviation", F.col("w.whitened").alias("whitened"), F.col("w.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
