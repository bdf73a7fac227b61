"""A vector store in a folder: namespaces, upserts, deletes by id or by filter, and searches of all cells or of the nearest ones.

Each change adds a segment: rows in folders by cell, or ids that are gone. The version file lists the segments of every namespace in order, and a later segment's word on an id is the one that counts;
`compact` puts a namespace's rows into one segment again. Cells are the centres of k-means over a sample: at most `SAMPLE` rows of the first upsert, those of the smallest hashes. Every row
is put into the cell of its nearest centre, whatever the sample held. A search of `probes` cells reads their folders only and may miss neighbours in others; one without `probes` is exact.

Ids are longs. Of rows of one id in one upsert the greatest (by vector, then metadata) stays; a null id or vector is not taken. A vector of another length than the first ones' is an error of the upsert, before
its version is made. Metadata is a map; a filter comes before the choice of the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.filters import metadata_match
from spindrift.operators import blocks
from spindrift.sources.versions import Versions

#: Rows that cells are fitted on, cells at most, rows of a block, queries of a block; superseded ids that are broadcast after being counted.
SAMPLE, CELLS, ROWS, QUERIES, BROADCAST_IDS = 50_000, 1024, 4096, 512, 500_000
ROW, GONE = "id long, vec array<float>, meta map<string,string>, cell int", "id long"


def fit_cells(rows: DataFrame, sample: int = SAMPLE, most: int = CELLS, seed: int = 7) -> list[list[float]]:
    """Unit centres of k-means over a bounded sample of unit vectors: the square root of the sample's size many."""
    drawn = rows.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(sample)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = drawn.select(array_to_vector(F.transform("vec", lambda x: x / F.greatest(norm, F.lit(1e-8)))).alias("features")).cache()
    try:
        n = unit.count()
        if not n:
            return []
        k = min(most, max(1, math.isqrt(n)))
        if k == 1:
            return [[0.0] * len(unit.first().features)]
        centres = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(unit).clusterCenters())
    finally:
        unit.unpersist()
    return (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-8)).round(6).tolist()


def in_cells(rows: DataFrame, centres: list[list[float]], probes: int = 1) -> DataFrame:
    """`rows` with `cell`: a row for each of the nearest `probes` centres of its `vec`, the first centre of equally near ones."""
    c = np.array(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            lengths = set(pa.compute.list_value_length(b.column("vec")).to_pylist())
            if lengths != {c.shape[1]}:
                raise ValueError(f"vectors of {sorted(lengths)} entries where {c.shape[1]} are stored")
            step = max(1, ROWS // probes)  # so that a batch that goes out has no more rows than a block, whatever the number of probes
            for at in range(0, b.num_rows, step):
                part = t.slice(at, step).combine_chunks()
                near = np.round(blocks.vectors_of(part) @ c.T, 9)
                order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                again = np.repeat(np.arange(part.num_rows), order.shape[1])
                yield from part.take(pa.array(again)).append_column("cell", pa.array(order.ravel(), pa.int32())).combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, cell int")


class VectorStore:
    """Vectors with metadata by namespace, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def _add(self, number: int, content: dict, namespace: str, segment: dict, name: str | None) -> int:
        spaces = dict(content.get("spaces", {}))
        spaces[namespace] = [*spaces.get(namespace, []), segment]
        return self.versions.commit(number, {**content, "spaces": spaces}, name)

    def upsert(self, rows: DataFrame, namespace: str = "", name: str | None = None) -> int:
        """Puts rows (id, vec, meta) in the place of those with their ids; `name` makes a rerun do nothing. Returns the version."""
        number, content = self.versions.current()
        if name and name in content.get("done", []):
            return number
        taken = rows.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"), F.col("meta").cast("map<string,string>").alias("meta") if "meta" in rows.columns else F.create_map().cast("map<string,string>").alias("meta"))
        one = taken.groupBy("id").agg(F.max(F.struct("vec", F.sort_array(F.map_entries("meta")).alias("meta"))).alias("x")).select("id", "x.vec", F.map_from_entries("x.meta").alias("meta"))
        centres = content.get("centres") or fit_cells(one)
        if not centres:
            return number
        folder = self.versions.folder("rows")
        in_cells(one, centres).repartition("cell", F.pmod("id", F.lit(8))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(folder)
        return self._add(number, {**content, "centres": centres}, namespace, {"folder": folder, "kind": "rows"}, name)

    def delete(self, ids: DataFrame, namespace: str = "", name: str | None = None) -> int:
        """Takes away the rows of `ids` (id)."""
        number, content = self.versions.current()
        if name and name in content.get("done", []):
            return number
        folder = self.versions.folder("gone")
        ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct().write.parquet(folder)
        return self._add(number, content, namespace, {"folder": folder, "kind": "gone"}, name)

    def delete_where(self, filters: dict, namespace: str = "", name: str | None = None) -> int:
        """Takes away the rows whose metadata match."""
        return self.delete(self.live(namespace).where(_match(filters)).select("id"), namespace, name)

    def live(self, namespace: str = "", cells: list[int] | None = None) -> DataFrame:
        """Rows (id, vec, meta, cell) of a namespace, of some cells only if they are given."""
        segments = self.versions.current()[1].get("spaces", {}).get(namespace, [])
        rows = ids = None
        for i, s in enumerate(segments):
            gone = s["kind"] == "gone"
            part = self.versions.load(s["folder"], GONE if gone else ROW)
            own = part.select("id", F.lit(i).alias("at"))
            ids = own if ids is None else ids.unionByName(own)
            if not gone:
                part = (part if cells is None else part.where(F.col("cell").isin(cells))).withColumn("at", F.lit(i))
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], ROW)
        if len(segments) > 1:
            last = ids.groupBy("id").agg(F.max("at").alias("last"), F.min("at").alias("first")).where("first < last").select("id", "last")
            rows = rows.join(F.broadcast(last) if last.count() <= BROADCAST_IDS else last, "id", "left").where("last is null or at = last").drop("last")
        return rows.drop("at")

    def compact(self, namespace: str = "") -> int:
        """Writes a namespace's rows into one segment."""
        number, content = self.versions.current()
        folder = self.versions.folder("rows")
        self.live(namespace).repartition("cell", F.pmod("id", F.lit(8))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(folder)
        return self.versions.commit(number, {**content, "spaces": {**content.get("spaces", {}), namespace: [{"folder": folder, "kind": "rows"}]}})

    def query(self, queries: DataFrame, k: int, namespace: str = "", filters: dict | None = None, probes: int | None = None) -> DataFrame:
        """(qid, id, score, rank): the k nearest rows by cosine of each query (qid, vec); of the nearest `probes` cells only, if given."""
        asked = queries.select(F.col("qid").cast("long").alias("qid"), "vec").where("vec is not null")
        centres = self.versions.current()[1].get("centres", [])
        if probes is None or probes >= len(centres):
            rows = blocks.packed(self.live(namespace).where(_match(filters)).select("id", "vec"), ROWS)
            return blocks.best(rows, blocks.packed(asked.repartition(max(1, -(-asked.count() // QUERIES))), QUERIES), blocks.cosine(k), k)
        probed = in_cells(asked, centres, probes)
        cells = [r.cell for r in probed.select("cell").distinct().collect()]  # no more than CELLS
        found = self.live(namespace, cells).where(_match(filters)).select("id", "vec", "cell")
        rows = blocks.packed(found.sortWithinPartitions("cell"), ROWS, on="cell")
        return blocks.best(rows, blocks.packed(probed.repartition("cell").sortWithinPartitions("cell"), QUERIES, on="cell"), blocks.cosine(k), k, on="cell")


def _match(filters: dict | None):
    return metadata_match(filters, lambda key: F.col("meta")[key])
