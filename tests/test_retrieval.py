"""Stored BM25 index and blocked joins against brute force."""

import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.operators import blocks, lexical
from spindrift.operators import retrieval as R
from spindrift.sources.versions import Conflict, Versions, shared_folder

WORDS = "der die das haus garten über x1 tion bank versicherung police schaden brief und oder".split()


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[: 3 + i % 12], rng.integers(0, 30)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "Haus, HAUS! haus_1 ÜBER")]


def brute(docs, queries, k):
    toks = lambda t: [w.lower() for w in re.findall(r"\w+", t or "")]
    d = {i: Counter(toks(t)) for i, t in docs}
    n, mean = len(d), sum(sum(c.values()) for c in d.values()) / len(d)
    df = Counter(w for c in d.values() for w in c)
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for q, t in queries:
        scores = []
        for i, c in d.items():
            s = sum((idf[w] if idf[w] >= 0 else floor) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in toks(t) if w in c)
            scores.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def hits(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.id, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w] and np.allclose([s for _, s in got[q]], [s for _, s in w], atol=1e-8)


QUERIES = [(7, "haus über haus"), (8, "fehlt ganz"), (9, "und oder tion und"), (10, "Der DIE das")]


@pytest.mark.parametrize("count", [4, 40])
def test_stored_index(spark, tmp_path, count):
    """Few queries are scored in the JVM, many in blocks; both as brute force, before and after a second segment."""
    docs = corpus(120)
    queries = [(q + 10 * i, t) for i in range(count // 4) for q, t in QUERIES]
    q = spark.createDataFrame(queries, "qid long, text string")
    stored = lexical.Stored(spark, f"file://{tmp_path}/index")
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    assert stored.search(q, 5).count() == 0
    stored.add(frame(docs[:70]), "first")
    same(hits(stored.search(q, 5)), brute(docs[:70], queries, 5))
    before = [f for f in Versions(spark, f"file://{tmp_path}/index").current()[1]["segments"]]
    stored.add(frame(docs[70:]), "second")
    assert stored.add(frame(docs[70:]), "second") == 2  # a rerun adds nothing
    assert stored.versions.current()[1]["segments"][0] == before[0]
    same(hits(stored.search(q, 6)), brute(docs, queries, 6))
    same(hits(R.bm25(frame(docs), q, 6)), brute(docs, queries, 6))


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    stored = lexical.Stored(spark, f"file://{tmp_path}/index")
    stored.add(spark.createDataFrame(corpus(300), "id long, text string"))
    found = stored.search(spark.createDataFrame([(1, "police")], "qid long, text string"), 3)
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (=|IN)", plan) and re.search(r"PushedFilters: \[.*EqualTo\(term,police\)", plan)


def test_one_query_of_a_stored_index_is_fast(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    stored = lexical.Stored(spark, f"file://{tmp_path}/index")
    stored.add(docs)
    q = spark.createDataFrame([(1, "The thanea of eriner and tionth the anly")], "qid long, text string")
    took = []
    for _ in range(4):
        began = time.time()
        got = hits(stored.search(q, 10))
        took.append(time.time() - began)
    print("warm search", took)
    assert [i for i, _ in got[1]] == [i for i, _ in hits(R.bm25(docs, q, 10))[1]]
    assert min(took) < 5


def test_dense_blocks(spark, monkeypatch):
    """Small blocks, ties and repeated vectors; query blocks broadcast, and joined where they are called too large."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(500, 6)), 1)
    v[100:200] = v[0]
    v[7] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None)], "id long, vec array<float>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(0, 500, 4)] + [(901, None)], "qid long, vec array<float>")
    unit = v.astype(np.float32).astype(float)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-8)
    want = {q: sorted(range(500), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:7] for q in range(0, 500, 4)}
    monkeypatch.setattr(R, "ROWS", 64)
    monkeypatch.setattr(R, "QUERIES", 16)
    assert {q: [i for i, _ in x] for q, x in hits(R.dense(rows, asked, 7)).items()} == want
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    joined = R.dense(rows, asked, 7)
    assert "CartesianProduct" in joined._jdf.queryExecution().toString()
    assert {q: [i for i, _ in x] for q, x in hits(joined).items()} == want
    assert R.dense(rows, asked.limit(0), 7).count() == 0 and R.dense(rows.limit(0), asked, 7).count() == 0


def test_blocks_keep_groups_whole(spark):
    ids = np.repeat(np.arange(50), np.arange(50) % 7 + 1)
    t = pa.table({"id": ids, "on": ids // 20})
    for size, groups in ((10, 99), (1000, 4), (3, 2), (1, 1)):
        cuts = blocks._cuts(t, size, "on", "id", groups)
        assert cuts[-1] == len(ids) and cuts == sorted(set(cuts)) and {int(np.searchsorted(ids, x)) for x in (20, 40)} <= set(cuts)
        for a, b in zip([0, *cuts], cuts):
            part = ids[a:b]
            assert len(set(part)) <= groups and (b - a <= size or len(set(part)) == 1)
            assert b == len(ids) or ids[b - 1] != ids[b]


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/table")
    assert v.current() == (0, {})
    assert v.commit(0, {"a": [{"folder": f"file://{tmp_path}/old"}]}, "x") == 1 and v.commit(1, {"a": 2}) == 2
    with pytest.raises(Conflict):
        Versions(spark, f"file://{tmp_path}/table").commit(1, {"a": 3})
    assert v.current() == (2, {"a": 2, "done": []}) and v.read(1)["done"] == ["x"]
    v.clean()
    assert v.numbers() == [2]
    assert shared_folder(spark, "t") != shared_folder(spark, "t")


def test_kernels_give_k_rows_a_query_and_batches_stay_small():
    """Equal rows by the thousand, as copies give them: what a kernel returns is k rows a query, by id among equals, and a query that goes to many cells goes in small batches."""
    rows = pa.table({"id": list(range(3000, 0, -1)), "vec": [[1.0, 0.0] if i % 3 else [0.6, 0.8] for i in range(3000)]})
    asked = pa.table({"qid": list(range(700)), "vec": [[1.0, 0.0]] * 700})
    q, i, s = blocks.cosine(4)(rows, asked)
    want = sorted(3000 - j for j in range(3000) if j % 3)[:4]
    assert len(q) == 2800 and np.array_equal(i.reshape(700, 4), np.tile(want, (700, 1))) and np.allclose(s, 1)
    terms = pa.table({"id": np.repeat(np.arange(5000), 2), "term": np.tile([7, 8], 5000), "value": np.tile([1.0, -2.0], 5000)})
    asks = pa.table({"qid": np.repeat(np.arange(400), 2), "term": np.tile([7, 9], 400), "value": np.ones(800)})
    q, i, s = blocks.sparse(3)(terms, asks)
    assert np.array_equal(q, np.repeat(np.arange(400), 3)) and np.array_equal(i, np.tile([0, 1, 2], 400)) and (s == 1).all()
    assert [len(x) for x in blocks.sparse(3)(terms, asks.slice(1, 1))] == [0, 0, 0]


def test_cells_of_many_queries_go_out_in_small_batches(spark):
    from types import SimpleNamespace

    from spindrift.operators import vector_store

    angle = np.arange(3000.0)
    batch = pa.RecordBatch.from_pydict({"id": np.arange(3000), "vec": np.stack([np.sin(angle), np.cos(angle)], 1).astype(np.float32).tolist()})
    held = SimpleNamespace(schema=spark.range(1).select("id", F.array(F.lit(1.0).cast("float")).alias("vec")).schema, mapInArrow=lambda run, kind: list(run(iter([batch]))))
    out = vector_store.in_cells(held, batch.column("vec").to_pylist()[:200], 150)
    assert max(b.num_rows for b in out) <= vector_store.ROWS and sum(b.num_rows for b in out) == 450_000
    t = pa.Table.from_batches(out)
    assert len(set(zip(t["id"].to_pylist(), t["cell"].to_pylist(), strict=True))) == 450_000


def test_tasks_of_a_segment_grow_with_its_tokens(spark, tmp_path, monkeypatch):
    """A segment of many tokens is counted and written by more tasks than the session's partitions, and gives the same hits."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(30))) for i in range(120)]
    frame, asked = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(1, "w3 w5 w39")], "qid long, text string")
    found = []
    for together in (100, 10**9):
        monkeypatch.setattr(lexical, "TOGETHER", together)
        stored = lexical.Stored(spark, f"file://{tmp_path}/{together}")
        stored.add(frame)
        found.append([tuple(r) for r in stored.search(asked, 10).orderBy("rank").collect()])
    files = lambda name: {f.name.split("-")[1] for f in (tmp_path / name).rglob("part-*.parquet") if "/postings/" in str(f)}
    assert len(files("100")) > 4 >= len(files(str(10**9)))
    assert found[0] == found[1] and len(found[0]) == 10
