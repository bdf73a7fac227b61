"""Sharding by a k-d tree of distributed weighted medians.

Groups of equal texts are the points: their weight is the bytes of all their rows, their
coordinates are metadata (source, language, size). A node that has to become k shards is split along
its widest dimension at the weighted quantile k//2 / k, until every leaf is one shard (or, by `shards_for`, until
leaves reach the target bytes). The quantile is found by histograms: over bins of the dimension, then, inside the bin
that holds it, over hash buckets of the groups, for several hashes of which the one that cuts nearest is taken.
Only aggregates of at most (leaves x bins) rows are windowed, and split points (one for each inner node) joined back.

A null text has size 1, as an empty one, and its text_crc32 is 0. Null metadata has coordinate 0. Rows with equal text
share a shard, so repeated rows do; each has a slot of its own. Of equally wide dimensions the first is split, of equally near cuts
the first hash's. A text larger than a shard's share fills its shard alone. An empty table gives an empty result. Columns that
are not named are ignored by `shard`; `place` keeps them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.scratch import Scratch, listed

BINS, BUCKETS, HASHES = 1024, 4096, 8
#: A shard's rows are numbered in so many parts at once, or more where parts would hold more rows than these.
SLOT_PARTS, PART_ROWS = 256, 1 << 20


def _hashed(c: Column) -> Column:
    """A string's coordinate, from 0 to 1; null: 0."""
    return F.when(c.isNull(), 0.0).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << 20)) / float(1 << 20))


def items(docs: DataFrame, *carry: str) -> DataFrame:
    """Carried columns, doc_id, size, text_crc32, group hash and coordinates of each row; texts go no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    columns = {c.lower() for c in docs.columns}
    meta = [_hashed(F.col(c)) if c in columns else F.lit(0.0) for c in ("source", "lang")]
    return docs.select(
        *carry,
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        *(m.alias(f"c{i}") for i, m in enumerate([*meta, F.log2(size) / 40.0])),
    )


def shards_for(rows: DataFrame, target_bytes: int) -> int:
    """Number of shards of at most about `target_bytes`."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // target_bytes))


def _crossing(sums: DataFrame, by: list[str], at: str, goal: Column) -> DataFrame:
    """For each `by`: where the running sum of w over `at` first reaches `goal`, with the sum before it (b) and w."""
    run = sums.withColumn("upto", F.sum("w").over(W.partitionBy(*by).orderBy(at)))
    return run.where(F.col("upto") >= goal).groupBy(*by).agg(F.min_by(F.struct(F.col(at).alias("at"), (F.col("upto") - F.col("w")).alias("b"), "w"), at).alias("x")).select(*by, "x.*")


def leaves(points: DataFrame, shards: int, scratch: Scratch, dims: int = 3) -> DataFrame:
    """(g, shard) of each point (g, w, c0..). Takes log2(shards) rounds, each over the points of nodes that are still to be split."""
    spread = points.agg(*(F.greatest(F.max(f"c{i}") - F.min(f"c{i}"), F.lit(1e-12)).alias(f"s{i}") for i in range(dims))).first()
    state = points.withColumn("lo", F.lit(0)).withColumn("k", F.lit(shards))
    level, most, done = 0, shards, [state.where("k = 1")]
    while most > 1:
        open_ = state.where("k > 1")
        nodes = open_.groupBy("lo", "k").agg(F.sum("w").alias("total"), *(f(f"c{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("min", F.min), ("max", F.max))))
        widths = [(F.col(f"max{i}") - F.col(f"min{i}")) / (spread[i] or 1.0) for i in range(dims)]
        widest = F.greatest(*widths) if dims > 1 else widths[0]
        pick = lambda f: F.coalesce(*(F.when(w == widest, f(i)) for i, w in enumerate(widths)))  # noqa: B023, E731
        left = F.floor(F.col("k") / 2).cast("int")
        nodes = nodes.select("lo", "k", pick(lambda i: F.lit(i)).alias("dim"), pick(lambda i: F.col(f"min{i}")).alias("low"), pick(lambda i: F.col(f"max{i}") - F.col(f"min{i}")).alias("width"), (F.col("total") * left / F.col("k")).alias("goal"))
        nodes = F.broadcast(scratch.save(nodes.coalesce(1)))  # at most one row for each shard
        value = F.coalesce(*(F.when(F.col("dim") == i, F.col(f"c{i}")) for i in range(dims)))
        bin_ = F.when(F.col("width") > 0, F.floor((value - F.col("low")) / F.col("width") * (BINS - 1))).otherwise(0).cast("int")
        binned = open_.join(nodes, ["lo", "k"]).withColumn("bin", bin_)
        first = _crossing(binned.groupBy("lo", "k", "goal", "bin").agg(F.sum("w").alias("w")), ["lo", "k", "goal"], "bin", F.col("goal"))
        first = F.broadcast(scratch.save(first.select("lo", "k", F.col("at").alias("cut"), (F.col("goal") - F.col("b")).alias("rest")).coalesce(1)))  # as many rows
        bucket = lambda salt: F.pmod(F.xxhash64(F.lit(level), salt, "g"), F.lit(BUCKETS)).cast("int")  # noqa: B023, E731
        inside = binned.join(first, ["lo", "k"]).where("bin = cut").withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(HASHES)))))
        sums = inside.withColumn("bucket", bucket(F.col("salt"))).groupBy("lo", "k", "rest", "salt", "bucket").agg(F.sum("w").alias("w"))
        second = _crossing(sums, ["lo", "k", "rest", "salt"], "bucket", F.col("rest"))
        over, under = F.col("b") + F.col("w") - F.col("rest"), F.col("rest") - F.col("b")
        second = second.select("lo", "k", "salt", F.when(over <= under, F.col("at")).otherwise(F.col("at") - 1).alias("last"), F.least(over, under).alias("off"))
        second = second.groupBy("lo", "k").agg(F.min_by(F.struct("salt", "last"), F.struct("off", "salt")).alias("x")).select("lo", "k", "x.*")
        splits = F.broadcast(scratch.save(nodes.join(first, ["lo", "k"]).join(second, ["lo", "k"], "left").coalesce(1)))  # as many rows
        goes_left = (F.col("bin") < F.col("cut")) | ((F.col("bin") == F.col("cut")) & (bucket(F.col("salt")) <= F.coalesce("last", F.lit(BUCKETS))))
        moved = open_.join(splits, ["lo", "k"]).withColumn("bin", bin_).withColumn("is_left", goes_left)
        moved = moved.select("g", "w", *(f"c{i}" for i in range(dims)), F.when(F.col("is_left"), F.col("lo")).otherwise(F.col("lo") + left).alias("lo"), F.when(F.col("is_left"), left).otherwise(F.col("k") - left).alias("k"))
        state = scratch.save(moved)
        done.append(state.where("k = 1"))
        level, most = level + 1, -(-most // 2)
    return reduce(DataFrame.unionByName, done).select("g", F.col("lo").alias("shard"))


def slots(rows: DataFrame, parts: int = SLOT_PARTS) -> DataFrame:
    """Adds a gapless slot from 0 in each shard, by doc_id's part, then doc_id, crc and size. No shard is gathered in one task."""
    parted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = parted.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return parted.withColumn("rank", rank).join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("rank") - 1).drop("part", "rank", "before")


def shard(docs: DataFrame, shards: int = 8, target_bytes: int | None = None, carry: tuple = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and carried columns of every row; equal texts share a shard and shards hold near equal bytes."""
    scratch = Scratch(docs.sparkSession, "kdshard")
    rows = scratch.save(items(docs, *carry))
    if target_bytes:
        shards = shards_for(rows, target_bytes)
    points = scratch.save(rows.groupBy("g").agg(F.sum("size").alias("w"), *(F.min(f"c{i}").alias(f"c{i}") for i in range(3))))
    placed = rows.join(leaves(points, shards, scratch), "g").select("doc_id", "size", "text_crc32", "shard", *carry)
    return slots(placed, max(SLOT_PARTS, -(-rows.count() // PART_ROWS)))


def place(docs: DataFrame, shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """All columns of every row, with its size, text_crc32, shard and slot; those replace columns of the same names.

    Rows are told apart by numbers that are written with them once, so that reading them again gives the same; texts move only where the rows are too many to be listed.
    """
    added = ("size", "text_crc32", "shard", "slot")
    scratch = Scratch(docs.sparkSession, "kdshard")
    kept = scratch.save(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = scratch.save(shard(kept, shards, target_bytes, ("__row",)).select("__row", *added))
    return kept.drop(*added).join(listed(found), "__row").drop("__row")
