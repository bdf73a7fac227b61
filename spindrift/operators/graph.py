"""Connected components by label propagation with jumps, for candidate graphs that are much smaller than their table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_folder(spark) -> None:
    """The cluster names the checkpoint folder; a session on one machine that names none, as in tests, gets a local one."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spindrift-"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node in edges (a, b): root is the smallest id reachable. Lineage is cut by checkpoint() each round.

    Joins are merged by hint: tables of nodes are small enough at times for a plan to broadcast one in each join of each round, which the driver would hold side by side.
    """
    checkpoint_folder(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("r"))
        stepped = labels.join(near.hint("merge"), "id").select("id", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = stepped.select(F.col("id").alias("root"), F.col("root").alias("far"))
        after = stepped.join(jump.hint("merge"), "root", "left").select("id", F.least("root", "far").alias("root"), "was").checkpoint()
        moved = after.where("root <> was").limit(1).count()
        labels = after.select("id", "root")
        if not moved:
            return labels


def leaders(edges: DataFrame) -> DataFrame:
    """(id, leader) of nodes in edges (a, b): in the order of ids, a node that no earlier leader is near leads, and others join the first leader near them.

    A node is decided as soon as all its smaller neighbours are, so rounds are as many as the longest chain of ids; near hashes have `dedup.leaders`, which needs neither edges nor such rounds.
    """
    checkpoint_folder(edges.sparkSession)
    down = edges.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("near")).where("id <> near").distinct().checkpoint()
    nodes = down.select("id").unionByName(down.select(F.col("near").alias("id"))).distinct()
    known = nodes.withColumn("leader", F.lit(None).cast(down.schema["id"].dataType)).checkpoint()
    while known.where("leader is null").limit(1).count():
        near = down.join(known.select(F.col("id").alias("near"), "leader"), "near")
        seen = near.groupBy("id").agg(F.count_if(F.col("leader").isNull()).alias("open"), F.min(F.when(F.col("leader") == F.col("near"), F.col("near"))).alias("first"), F.min(F.when(F.col("leader").isNull(), F.col("near"))).alias("undecided"))
        fresh = known.join(seen, "id", "left")
        ready = F.col("first").isNotNull() & (F.col("undecided").isNull() | (F.col("first") < F.col("undecided")))
        leader = F.when(F.col("leader").isNotNull(), F.col("leader")).when(ready, F.col("first")).when(F.coalesce("open", F.lit(0)) == 0, F.coalesce("first", "id"))
        known = fresh.select("id", leader.alias("leader")).checkpoint()
    return known
