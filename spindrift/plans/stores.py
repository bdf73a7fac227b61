"""Queries of the stores that live in folders: changes that reach documents and chunks, and vectors by namespace."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators.document_store import DocumentStore
from spindrift.operators.vector_store import VectorStore
from spindrift.plans.registry import query
from spindrift.plans.retrieval import RANKED
from spindrift.plans.store import CHUNKS, chunks
from spindrift.session import table
from spindrift.sources.versions import shared_folder


@query("metadata_cascade", f"""WITH {CHUNKS}, d AS (SELECT doc_id, 'lang=' || coalesce(lang, '') || CASE WHEN doc_id % 3 = 0 THEN ',n=' || doc_id % 10 || ',source=NEW' ELSE ',source=' || coalesce(source, '') END AS meta FROM documents)
SELECT chunk_id, doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 <> 0 AND page % 2 = 1 THEN 'page=' || page ELSE meta END AS meta FROM chunks JOIN d USING (doc_id)""")
def metadata_cascade(spark, sf_dir):
    """Chunks after metadata of every third document were merged; a null value is left out, and a rerun of the change does nothing."""
    store = DocumentStore(spark, shared_folder(spark, "documents"))
    d = table(spark, sf_dir, "documents")
    own = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))
    store.put(d.select("doc_id", F.lit("t").alias("title"), "source", own.alias("meta")), "documents")
    c = chunks(spark, sf_dir)
    store.add_chunks(c.select("chunk_id", "doc_id", F.col("page").cast("int").alias("page"), "text", F.when(F.col("page") % 2 == 1, F.create_map(F.lit("page"), F.col("page").cast("string"))).alias("meta")), "chunks")
    change = d.where("doc_id % 3 = 0").select("doc_id", F.create_map(F.lit("lang"), F.lit(None).cast("string"), F.lit("source"), F.lit("NEW"), F.lit("n"), (F.col("doc_id") % 10).cast("string")).alias("meta"))
    for _ in range(2):
        store.update_metadata(change, "change")
    spelt = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return store.read("chunks").select("chunk_id", "doc_id", spelt.alias("meta"))


def vector_store(spark, sf_dir) -> VectorStore:
    """A store of all embeddings: every tenth vector was replaced by its reverse, every seventh id and label 3 deleted."""
    store = VectorStore(spark, shared_folder(spark, "vectors"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("meta"))
    store.upsert(e, "main", "all")
    store.upsert(e.where("id % 10 = 0").withColumn("vec", F.reverse("vec")), "main", "tenth")
    store.upsert(e.where("id < 3"), "other", "other")
    store.delete(e.where("id % 7 = 0"), "main", "seventh")
    store.delete_where({"label": "3"}, "main", "label")
    return store


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


_NORM = lambda v: f"sqrt(list_inner_product({v}, {v}))"


@query("vector_store", f"""WITH s AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 10 = 0 THEN list_reverse(embedding)::DOUBLE[] ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 7 <> 0 AND (label <> 3 OR label IS NULL)),
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT qid, id, list_inner_product(u, v) / ({_NORM('u')} * {_NORM('v')}) AS score FROM q, s WHERE label IN (1, 2, 5))
SELECT qid, id, round(score, 6) AS score, {RANKED} AS rank FROM n QUALIFY rank <= 5""")
def stored_vectors(spark, sf_dir):
    """Five nearest live rows of a namespace that pass a filter, after upserts and deletions, over all cells."""
    found = vector_store(spark, sf_dir).query(_asked(spark, sf_dir), 5, "main", {"label__in": ["1", "2", "5"]})
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_store_cells")
def stored_cells(spark, sf_dir):
    """The same rows without a filter, from the nearest three quarters of the cells of each query: these vectors have little structure, half of the cells give a recall of 0.84."""
    store = vector_store(spark, sf_dir)
    store.compact("main")
    cells = len(store.versions.current()[1]["centres"])
    return store.query(_asked(spark, sf_dir), 10, "main", probes=-(-cells * 3 // 4)).select("qid", "id", F.round("score", 6).alias("score"), "rank")
