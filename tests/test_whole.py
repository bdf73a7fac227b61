"""Registered queries over tables larger than those of test_queries.py: every row counts."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizerModel, StopWordsRemover
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import graph, joins, lexical
from spindrift.plans import answers, registry, retrieval
from spindrift.session import spread, table

SF = "/root/testdata/sf0.01"


def some_documents(spark, tmp_path, where):
    """A directory with some documents of SF, and their rows."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where(where)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), d.select("doc_id", "text").collect()


def brute_chars(lengths, most, overlap):
    out, current, used = [], [], 0
    for n in lengths:
        if current and used + n + 1 > most:
            out.append(current)
            kept = []
            while len(kept) < len(current) and sum(kept) + current[-len(kept) - 1] < overlap:
                kept = current[len(current) - len(kept) - 1 :]
            current, used = kept, sum(kept)
        current, used = [*current, n], used + n + 1
    return [*out, current]


def test_chunks_chars_of_all_documents(spark, tmp_path):
    at, docs = some_documents(spark, tmp_path, "doc_id between 280 and 340 or doc_id >= 990")
    want = [(d.doc_id, n, len(c), sum(c) + len(c) - 1) for d in docs for n, c in enumerate(brute_chars([len(s) for s in re.split(r"(?<=[.!?])\s+", d.text)], 400, 60))]
    got = registry.QUERIES["chunks_chars"](spark, at).select("doc_id", "n", "n_sentences", "n_chars")
    assert max(w[0] for w in want) == 999 and sorted(map(tuple, got.collect())) == sorted(want)


def test_ngram_terms_of_all_documents(spark, tmp_path):
    at, _ = some_documents(spark, tmp_path, "doc_id between 190 and 240 or doc_id >= 990")
    got = registry.QUERIES["ngram_terms"](spark, at).select("doc_id", "terms", "digest")
    sql = registry.ORACLES["ngram_terms"].replace("FROM documents", f"FROM '{at}/documents.parquet/*.parquet'")
    want = duckdb.sql(sql).select("doc_id", "terms", "digest").fetchall()
    assert len(want) == 61 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("most", [20_000, 0])
def test_eval_retrieval_of_all_items(spark, tmp_path, monkeypatch, most):
    sf, rows = some_documents(spark, tmp_path, "doc_id < 60")
    items = [(i, " ".join(r.text.split(" ")[:20])) for i, r in enumerate(sorted(rows)[:30])]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(answers, "BROADCAST_ITEMS", most)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    want = con.execute(f"""WITH q AS (SELECT item_id AS qid, text FROM benchmark), {retrieval.BM25}, {answers._EVAL}, r AS (SELECT qid, id, {retrieval.RANKED} AS rank FROM bm QUALIFY rank <= 5),
        f AS (SELECT item_id, min(rank) AS rank FROM gold LEFT JOIN r ON qid = item_id AND id = doc_id GROUP BY item_id)
        SELECT count(*), round(avg(coalesce(rank <= 1, false)::INT), 6), round(avg(coalesce(rank <= 3, false)::INT), 6), round(avg(coalesce(rank <= 5, false)::INT), 6), round(avg(coalesce(1 / rank, 0)), 6) FROM f""").fetchone()
    got = registry.QUERIES["eval_retrieval"](spark, sf).select("queries", "hit_1", "hit_3", "hit_5", "mrr").first()
    assert want[0] > 10 and tuple(got) == want


@pytest.mark.parametrize("most", [20_000, 0])
def test_f4_items_of_any_length_and_place_are_found(spark, tmp_path, monkeypatch, most):
    """items of fewer than six words, inside of words, of blanks, of one byte and empty are gold where the SQL's contains() says so."""
    sf, rows = some_documents(spark, tmp_path, "doc_id < 40")
    text = {r.doc_id: r.text for r in rows}
    parts = ["", " ", "\n", "e", "th", "ß", "the ", "zzzz", text[0][:1], text[1][:15], text[2][3:40], text[3][1:75], text[4][2:150], text[5][5:400], text[6], text[6] + "x", text[7][-60:], *(text[i][i : i + n] for i in range(8, 40) for n in (5, 8, 9, 31, 64, 65, 127, 128, 129))]
    spark.createDataFrame([*enumerate(parts), (len(parts), None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    want = con.execute(f"WITH {answers._EVAL} SELECT doc_id, item_id FROM gold ORDER BY ALL").fetchall()
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = joins.containing(d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("qid"), F.col("text").alias("item")), most)
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(answers, "BROADCAST_ITEMS", most)
    assert registry.QUERIES["eval_retrieval"](spark, sf).first()["queries"] == len({q for _, q in want})


def test_bm25_cuts_texts_twice(spark, monkeypatch):
    """Once for the counts of terms and once for the postings, whatever reads the counts."""
    rows = [(i, f"a{i % 7} b{i % 3} " * (i % 4)) for i in range(50)]
    chunks = spark.createDataFrame([*rows, (50, None)], "id long, text string").repartition(4)
    cut = spark.sparkContext.accumulator(0)
    plain = T.tokens

    @F.udf("array<string>")
    def counted(text):
        cut.add(1)
        return None if text is None else re.findall(r"\w+", text.lower())

    found = []
    queries = spark.createDataFrame([(q, f"a{q % 7} b{q % 3}") for q in range(40)], "qid long, text string").localCheckpoint()
    for tokens in (plain, counted):
        monkeypatch.setattr(T, "tokens", tokens)
        index = lexical.over(chunks)
        monkeypatch.setattr(T, "tokens", plain)
        found.append(sorted((r.qid, r.id, r.rank) for r in lexical.search(index, queries, 5).collect()))
    assert found[0] == found[1] and len(found[0]) == 200 and cut.value == 2 * 51


def test_kmeans_tfidf_is_the_plain_pipeline_and_cuts_texts_twice(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    graph.checkpoint_folder(spark)
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).checkpoint().select("doc_id", T.tokens(F.col("text")).alias("words"))
    remover = StopWordsRemover(inputCol="words", outputCol="kept")
    n = Counter(w for r in remover.transform(d).select("kept").collect() for w in r.kept)
    counts = CountVectorizerModel.from_vocabulary(sorted(n, key=lambda w: (-n[w], w))[:1000], inputCol="kept", outputCol="tf")
    steps = [remover, counts, IDF(inputCol="tf", outputCol="features"), KMeans(k=10, seed=42, maxIter=10)]
    want = Pipeline(stages=steps).fit(d).transform(d).select("doc_id", "prediction").collect()
    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(text):
        cut.add(1)
        return re.findall(r"\w+", text.lower())

    monkeypatch.setattr(T, "tokens", counted)
    got = registry.QUERIES["kmeans_tfidf"](spark, sf).collect()
    assert len(got) == 200 and cut.value == 400
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_kmeans_tfidf_of_a_null_text(spark, tmp_path):
    sf, _ = some_documents(spark, tmp_path, "doc_id < 60")
    spark.createDataFrame([(1000, None)], "doc_id long, text string").write.mode("append").parquet(f"{sf}/documents.parquet")
    assert registry.QUERIES["kmeans_tfidf"](spark, sf).where("cluster between 0 and 9").count() == 61


def test_mmr_answers_every_20th_vector(spark):
    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["mmr"](spark, sf).groupBy("qid").count().collect()
    want = duckdb.sql(f"SELECT vec_id FROM '{sf}/embeddings.parquet' WHERE vec_id % 20 = 0").fetchall()
    assert len(want) == 25 and sorted(r.qid for r in got) == sorted(w[0] for w in want) and all(r["count"] == 5 for r in got)
