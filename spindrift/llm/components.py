"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join, so a hub with very many neighbours
is split by adaptive execution and no neighbourhood is gathered in one task. Between rounds
the edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.scratch import Scratch


def _hook(pairs: DataFrame, lower_only: bool) -> DataFrame:
    """Edges (a, b) with b < a, re-hooked to the smallest neighbour of each node.

    lower_only False: large star, the node's larger neighbours go to its minimum.
    lower_only True: small star, the node and its smaller neighbours go to its minimum.
    """
    if lower_only:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        joined = pairs.join(least, "a")
        moved = joined.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a").where("b > a")
        moved = joined.select(F.col("b").alias("x"), "m")
    return moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) touches; root is the smallest node reachable.

    Edges may repeat, run either way or be loops; nulls are dropped. No edge: no row.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        now = scratch.save(_hook(_hook(now, False), True))
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if scratch.count > 2:
            scratch.drop(scratch.count - 2)
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
