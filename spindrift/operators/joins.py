"""Joins that Spark has no operator for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """`left` with the values of the last right row at or before it: a union and one sorted window, so each key's rows are read once.

    Of right rows with equal `at`, the greatest by the values counts. Rows without one get nulls.
    """
    held = F.struct(*values)
    rows = left.withColumn("__right", F.lit(0)).withColumn("__held", F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType))
    known = right.select(*by, at, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*by, at)), F.lit(1).alias("__right"), held.alias("__held"))
    order = W.partitionBy(*by).orderBy(at, F.col("__right").desc(), "__held").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = rows.unionByName(known).withColumn("__last", F.last("__held", ignorenulls=True).over(order)).where("__right = 0")
    return both.select(*left.columns, *(F.col("__last")[v].alias(v) for v in values))


#: Bytes of the longest window that a seed is taken from.
LONGEST = 128
_OF_BYTE = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _window(n: int) -> int:
    """Bytes of the window that stands for a text of n bytes: a power of two, no longer than the text."""
    return min(LONGEST, 1 << (n.bit_length() - 1)) if n else 0


def _minima(data: np.ndarray, size: int) -> np.ndarray:
    """The smallest hash of a run in each window of `size` bytes, each once; runs are half a window, in windows of up to four bytes the window itself. So what holds a text has all its seeds, wherever the text begins."""
    if not size:
        return np.zeros(1, np.int64)
    if len(data) < size:
        return np.zeros(0, np.int64)
    run = size if size <= 4 else size // 2
    h, have, by = _OF_BYTE[data], 1, _STEP
    while have < run:
        h = h[:-have] * by + h[have:]
        have, by = 2 * have, by * by
    held = 1
    while held < size - run + 1:
        step = min(held, size - run + 1 - held)
        h = np.minimum(h[:-step], h[step:])
        held += step
    return np.unique(h).view(np.int64)


def _seeds(sizes: list[int]):
    """A column function: the seeds of a text in windows of each of the sizes; null for null."""

    @F.arrow_udf("array<bigint>")
    def seeds(text: pa.Array) -> pa.Array:
        raw = (t.as_py() for t in text.cast(pa.binary()))
        found = [None if t is None else np.unique(np.concatenate([_minima(np.frombuffer(t, np.uint8), n) for n in sizes])) for t in raw]
        return pa.array(found, pa.list_(pa.int64()))

    return seeds


def _seed():
    """A column function: the window's size of a text and the seed of its first window; null for null."""

    @F.arrow_udf("struct<size int, seed bigint>")
    def seed(text: pa.Array) -> pa.Array:
        raw = text.cast(pa.binary()).to_pylist()
        sizes = [None if t is None else _window(len(t)) for t in raw]
        seeds = [None if t is None else int(_minima(np.frombuffer(t[:n], np.uint8), n)[0]) for t, n in zip(raw, sizes, strict=True)]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(seeds, pa.int64())], names=["size", "seed"])

    return seed


def containing(texts: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(id, qid), each once, of the texts (id, text) that hold an item (qid, item) as a part, at any place; an empty item is part of every text, null of none.

    Texts and items meet by a seed, the smallest hash in a window of the item's bytes, and what meets is compared in full. Up to `most` items are broadcast; with more, seeds are joined by a shuffle and the
    texts come to the pairs, once each.
    """
    asked = items.select("qid", "item", _seed()("item").alias("x")).select("qid", "item", "x.*").where("seed is not null")
    sizes = {r["size"]: r["n"] for r in asked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = asked.drop("size")
    if sum(sizes.values()) <= most:
        spots = texts.select("id", "text", F.explode(_seeds(sorted(sizes))("text")).alias("seed"))
        met = spots.join(F.broadcast(asked), "seed")
    else:
        spots = texts.select("id", F.explode(_seeds(sorted(sizes))("text")).alias("seed"))
        met = spots.join(asked.hint("merge"), "seed").select("id", "qid", "item").distinct().join(texts.hint("merge"), "id")
    return met.where(F.contains("text", F.col("item"))).select("id", "qid").distinct()
