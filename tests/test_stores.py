"""Stores in folders against plain dictionaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import vector_store as V
from spindrift.operators.document_store import BUCKETS, DocumentStore
from spindrift.plans import registry, stores
from spindrift.sources.versions import Conflict

META = "map<string,string>"


def test_metadata_reach_the_chunks(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/s")
    assert store.read("documents").count() == 0
    docs = [(str(i), f"t{i}", None, {"a": str(i), "k": "old"} if i % 2 else None) for i in range(40)] + [("3", "a", None, {"a": "0"})]
    store.put(spark.createDataFrame(docs, f"doc_id string, title string, source string, meta {META}"))
    store.put(spark.createDataFrame([(None, "new", "s", {"x": "1"}), ("5", "t5", "src", {"a": "five"})], f"doc_id string, title string, source string, meta {META}"))
    got = {r.doc_id: r for r in store.read("documents").collect()}
    assert len(got) == 41 and got["5"].meta == {"a": "five"} and got["3"].title == "t3" and sum(r.title == "new" and len(r.doc_id) == 36 for r in got.values()) == 1
    chunks = [(f"{i}_{j}", str(i), j, "x", {"own": "1"} if j else None) for i in range(42) for j in range(3)]
    frame = spark.createDataFrame(chunks, f"chunk_id string, doc_id string, page int, text string, meta {META}")
    store.add_chunks(frame, "c")
    store.add_chunks(frame)  # all known
    have = {r.chunk_id: r.meta for r in store.read("chunks").collect()}
    assert len(have) == 120 and have["7_0"] == {"a": "7", "k": "old"} and have["7_1"] == {"own": "1"}
    before = store.versions.current()[0]
    entries = store.versions.current()[1]
    change = spark.createDataFrame([("7", {"k": "new", "gone": None}), ("7", {"a": "0"}), ("8", {"z": "1"}), ("999", {"z": "1"}), (None, {"z": "1"}), ("9", None)], f"doc_id string, meta {META}")
    number = store.update_metadata(change, "change")
    assert store.update_metadata(change, "change") == number == before + 1
    meta = {r.doc_id: r.meta for r in store.read("documents").collect()}
    assert meta["7"] == {"a": "7", "k": "new"} and meta["8"] == {"z": "1"} and meta["9"] == got["9"].meta and "999" not in meta
    after = {r.chunk_id: r.meta for r in store.read("chunks").collect()}
    assert after == {c: meta[c.split("_")[0]] if c.split("_")[0] in ("7", "8") else m for c, m in have.items()}
    now = store.versions.current()[1]
    moved = sum(a != b for a, b in zip(*(sorted(x["chunks"], key=lambda e: e["bucket"]) for x in (entries, now)), strict=True))
    assert 1 <= moved <= 2 < BUCKETS  # folders of two documents at most were written
    assert {r.chunk_id: r.meta for r in store.read("chunks", version=before).collect()} == have
    with pytest.raises(Conflict):
        store.versions.commit(before, {})
    store.versions.clean()
    assert {r.chunk_id: r.meta for r in store.read("chunks").collect()} == after


def nearest(rows, q, k):
    unit = lambda v: v / max(np.linalg.norm(v), 1e-8)
    u = unit(np.asarray(q, np.float32).astype(float))
    return [i for _, i in sorted((-round(float(u @ unit(np.asarray(v, np.float32).astype(float))), 9), i) for i, v in rows.items())[:k]]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append(r.id)
    return out


def test_vector_store(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8)).round(3)
    frame = lambda rows: spark.createDataFrame(rows, f"id long, vec array<float>, meta {META}")
    row = lambda i, x, **m: (i, None if x is None else [float(c) for c in x], m)
    s = V.VectorStore(spark, f"file://{tmp_path}/v")
    q = spark.createDataFrame([(i, [float(c) for c in v[i]]) for i in range(0, 300, 25)], "qid long, vec array<float>")
    assert s.query(q, 3).count() == 0
    s.upsert(frame([row(i, x, kind=str(i % 3)) for i, x in enumerate(v)] + [row(None, v[0]), row(900, None)]), "a", "first")
    want = dict(enumerate(v))
    assert found(s.query(q, 6, "a")) == {i: nearest(want, v[i], 6) for i in range(0, 300, 25)} and s.query(q, 6, "b").count() == 0
    s.upsert(frame([row(i, v[i + 1], kind="9") for i in range(0, 50, 2)] + [row(1000, v[3], kind="9"), row(1000, v[2], kind="9")]), "a", "second")
    want |= {i: v[i + 1] for i in range(0, 50, 2)} | {1000: max(v[2].tolist(), v[3].tolist())}
    s.delete(spark.createDataFrame([(4,), (4,), (77,), (12345,), (None,)], "id long"), "a")
    s.upsert(frame([row(4, v[200], kind="1")]), "a")
    want = {i: x for i, x in want.items() if i != 77} | {4: v[200]}
    assert found(s.query(q, 6, "a")) == {i: nearest(want, v[i], 6) for i in range(0, 300, 25)}
    s.delete_where({"kind": "9"}, "a")
    want = {i: x for i, x in want.items() if not (i < 50 and i % 2 == 0 and i != 4) and i != 1000}
    kinds = {i: "1" if i == 4 else str(i % 3) for i in want}
    assert found(s.query(q, 4, "a", {"kind__in": ["1"]})) == {i: nearest({j: x for j, x in want.items() if kinds[j] == "1"}, v[i], 4) for i in range(0, 300, 25)}
    assert s.upsert(frame([row(1, v[1])]), "a", "first") == s.versions.current()[0]  # a rerun
    monkeypatch.setattr(V, "BROADCAST_IDS", 0)
    assert {r.id for r in s.live("a").collect()} == set(want)
    with pytest.raises(Exception, match="vectors of"):
        s.upsert(frame([row(5, v[0][:3])]), "a")
    s.compact("a")
    s.versions.clean()
    assert len(s.versions.current()[1]["spaces"]["a"]) == 1 and found(s.query(q, 6, "a")) == {i: nearest(want, v[i], 6) for i in range(0, 300, 25)}


def test_cells_reach_the_recall_and_are_pruned(spark):
    sf = "/root/testdata/sf0.01"
    s = stores.vector_store(spark, sf)
    s.compact("main")
    asked = stores._asked(spark, sf)
    exact = found(s.query(asked, 10, "main"))
    got = found(registry.QUERIES["vector_store_cells"](spark, sf))
    recall = np.mean([len(set(got.get(q, [])) & set(w)) / len(w) for q, w in exact.items()])
    print("recall", recall)
    assert recall >= 0.9
    cells = len(s.versions.current()[1]["centres"])
    assert found(s.query(asked, 10, "main", probes=cells)) == exact
    one = s.query(asked.limit(1), 3, "main", probes=2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]
