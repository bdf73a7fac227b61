"""The document and chunk store: latest-wins upserts, merges and slices over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with their key; other rows of both stay. One full outer join on the key."""
    a, b = old.alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    pick = [F.when(F.col("b.__new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *pick)


def insert_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose key `old` has not."""
    return new.join(old.select(key), key, "left_anti")


def latest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last row of each key; a sort-free aggregate."""
    rest = [c for c in rows.columns if c not in by]
    found = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return found.select(*by, "x.*")


def merge_maps(old: Column, new: Column) -> Column:
    """Map of both, the new value where both have a key. Keys of `new` are taken from `old` first, so no map has doubles."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(new, F.create_map().cast("map<string,string>")))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def slices(text: Column, size: int = 1000) -> Column:
    """array<string> of every `size` characters."""
    last = F.floor((F.length(text) - 1) / size)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.substring(text, (i * size + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<string>"))


def first_of(rows: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__rank = 1").drop("__rank")
