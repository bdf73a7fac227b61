"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where a session on one machine names none, as in tests, a local one is set; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Folders of the tables written by this process and not deleted yet, in order.
ROOTS: list[str] = []


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes all intermediate tables written after the first `since` folders: for when what was made from them is written or no longer wanted."""
    while len(ROOTS) > since:
        delete(spark, ROOTS.pop())


class Scratch:
    """Tables written once and read back, so that lineage ends there and lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        ROOTS.append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes `df` as Parquet and reads it back with its schema."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, index: int) -> None:
        """Deletes the table of that number, once nothing reads it."""
        delete(self.spark, f"{self.root}/{index}")


#: Rows of a few numbers that are broadcast at most, after being counted; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def listed(rows: DataFrame) -> DataFrame:
    """`rows`, to be broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
