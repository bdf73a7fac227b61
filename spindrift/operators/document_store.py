"""Documents and their chunks in a folder, changed together: metadata of a document reach its chunks in the same version.

Both tables lie in folders by a hash of the document's id. A change rewrites only the folders that it touches and names them in one new version file, so readers see both tables before it or both
after it, and a change that breaks off leaves nothing behind but unnamed files. A change with a name is done once.

Ids are strings; a document without one gets a random one. Of rows of one id in one change the greatest stays. Metadata are maps: a change's values win, its nulls are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.store import merge_maps, without_nulls
from spindrift.sources.versions import Versions

#: Folders of each table; document ids of a change that are broadcast after being counted.
BUCKETS, BROADCAST_IDS = 32, 500_000
SCHEMAS = {"documents": "doc_id string, title string, source string, meta map<string,string>", "chunks": "chunk_id string, doc_id string, page int, text string, meta map<string,string>"}


def bucket(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("binary")) % BUCKETS).cast("int")


def _greatest(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the greatest of the others' columns; maps compare as their sorted entries."""
    rest = [f for f in rows.schema.fields if f.name != key]
    own = F.struct(*(F.sort_array(F.map_entries(f.name)).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in rest))
    back = [F.map_from_entries(F.col("x")[f.name]).alias(f.name) if f.dataType.typeName() == "map" else F.col("x")[f.name].alias(f.name) for f in rest]
    return rows.groupBy(key).agg(F.max(own).alias("x")).select(key, *back)


class DocumentStore:
    """Documents (doc_id, title, source, meta) and chunks (chunk_id, doc_id, page, text, meta)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def read(self, table: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table at its last version, or at an earlier one, of some folders only if they are given."""
        content = self.versions.current()[1] if version is None else self.versions.read(version) if version else {}
        out = self.spark.createDataFrame([], SCHEMAS[table])
        for folder, held in _by_folder(content.get(table, []), buckets).items():
            part = self.spark.read.schema(SCHEMAS[table]).option("basePath", folder).parquet(*(f"{folder}/bucket={b}" for b in held))
            out = out.unionByName(part.select(*out.columns))
        return out

    def _write(self, table: str, rows: DataFrame, buckets: list[int], content: dict) -> dict:
        """`content` with new folders for those buckets of a table, whose rows are `rows`."""
        folder = self.versions.folder(table)
        placed = rows.withColumn("bucket", bucket(F.col("doc_id")))
        placed.repartition("bucket", F.pmod(F.xxhash64(*[c for c in rows.columns if c.endswith("_id")]), F.lit(8))).write.partitionBy("bucket").parquet(folder)
        full = {r.bucket for r in self.spark.read.parquet(folder).select("bucket").distinct().collect()} if any(f.getPath().getName().startswith("bucket=") for f in self.versions.files.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder))) else set()
        kept = [e for e in content.get(table, []) if e["bucket"] not in buckets]
        return {**content, table: kept + [{"bucket": b, "folder": folder} for b in sorted(full)]}

    def _touched(self, ids: DataFrame) -> list[int]:
        return [r.b for r in ids.select(bucket(F.col("doc_id")).alias("b")).distinct().collect()]  # no more than BUCKETS

    def _start(self, name: str | None) -> tuple[int, dict, bool]:
        number, content = self.versions.current()
        return number, content, bool(name) and name in content.get("done", [])

    def put(self, documents: DataFrame, name: str | None = None) -> int:
        """Documents replaced or added. Returns the version."""
        number, content, done = self._start(name)
        if done:
            return number
        new = documents.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.uuid()))
        drafts = self.versions.folder("draft")  # random ids are drawn once
        _greatest(new.select("doc_id", "title", "source", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta")), "doc_id").write.parquet(drafts)
        new = self.versions.load(drafts, SCHEMAS["documents"])
        held = self._touched(new)
        kept = self.read("documents", held).join(self._small(new.select("doc_id")), "doc_id", "left_anti")
        made = self.versions.commit(number, self._write("documents", kept.unionByName(new), held, content), name)
        self.versions.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(drafts), True)
        return made

    def add_chunks(self, chunks: DataFrame, name: str | None = None) -> int:
        """Chunks of known documents whose ids the store has not; a chunk without metadata takes its document's."""
        number, content, done = self._start(name)
        if done:
            return number
        own = _greatest(chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "page", "text", "meta").where("chunk_id is not null"), "chunk_id")
        held = self._touched(own)
        old = self.read("chunks", held)
        documents = self.read("documents", held).select("doc_id", F.col("meta").alias("of"))
        new = own.join(old.select("chunk_id"), "chunk_id", "left_anti").join(documents, "doc_id").select("chunk_id", "doc_id", "page", "text", F.coalesce("meta", "of").alias("meta"))
        return self.versions.commit(number, self._write("chunks", old.unionByName(new), held, content), name)

    def update_metadata(self, changes: DataFrame, name: str | None = None) -> int:
        """Merges metadata (doc_id, meta) into their documents; the chunks of these documents get the merged metadata. Ids that the store has not are left out."""
        number, content, done = self._start(name)
        if done:
            return number
        new = _greatest(changes.select(F.col("doc_id").cast("string").alias("doc_id"), without_nulls(F.col("meta")).alias("new")).where("doc_id is not null and new is not null"), "doc_id")
        held = self._touched(new)
        merged = self.read("documents", held).join(self._small(new), "doc_id", "left").withColumn("meta", F.when(F.col("new").isNotNull(), merge_maps(F.col("meta"), F.col("new"))).otherwise(F.col("meta")))
        content = self._write("documents", merged.drop("new"), held, content)
        changed = merged.where("new is not null").select("doc_id", F.col("meta").alias("of"))
        chunks = self.read("chunks", held).join(self._small(changed), "doc_id", "left").withColumn("meta", F.coalesce("of", "meta")).drop("of")
        return self.versions.commit(number, self._write("chunks", chunks.select("chunk_id", "doc_id", "page", "text", "meta"), held, content), name)

    def _small(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _by_folder(entries: list[dict], buckets: list[int] | None) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for e in entries:
        if buckets is None or e["bucket"] in buckets:
            out.setdefault(e["folder"], []).append(e["bucket"])
    return out
