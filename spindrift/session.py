"""Session construction and table access."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every scale; sizes of partitions are left to adaptive execution.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with BASE_CONF; `master` only for local runs, a cluster names its own."""
    builder = SparkSession.builder.appName("spindrift").config(map=BASE_CONF | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, for functions that run in Python there."""
    context = spark.sparkContext
    if getattr(context, "_spindrift_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spindrift-")) / "spindrift_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._spindrift_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table by name."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, for texts whose work costs more than a shuffle of their bytes.

    Only a table too small to be cut into a partition for each core by the reader is dealt anew (one row group is one task); a large one stays as it is read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (16 << 20) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, over all cores."""
    return spread(table(spark, sf_dir, "documents"))
