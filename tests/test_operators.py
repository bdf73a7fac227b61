"""Small golden cases of the operators, with empty, null and tied rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import filters, rules
from spindrift.functions import text as T
from spindrift.operators import answers, chunking, dedup, graph, joins, retrieval, store


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_sentences_and_tokens(spark):
    c = F.col("t")
    assert one(spark, T.sentences(c), t=" One. Two!  Three? four ") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.sentences(c), t="") == []
    assert one(spark, T.approx_tokens(c), t="") == 1
    assert one(spark, T.tokens(c), t="Über-Größe_1, ok") == ["über", "größe_1", "ok"]
    assert one(spark, T.clean(c), t="aB\x00c.Dd  e\n") == "a Bc. Dd e"
    assert one(spark, T.nfc(c), t="é") == "é"


def test_headings(spark):
    page = "1 Introduction\nplain text here.\n1.2 More on it\nTERMS AND USE\n3.1.2 Deep"
    h = one(spark, T.hierarchy(T.headings(F.col("t"))), t=page)
    assert [(r.offset, r.number, r.title, r.path) for r in h] == [
        (0, "1", "Introduction", ["Introduction"]), (32, "1.2", "More on it", ["Introduction", "More on it"]),
        (47, "", "Terms And Use", ["Terms And Use"]), (61, "3.1.2", "Deep", ["Terms And Use", "", "Deep"]),
    ]


def test_filters(spark):
    df = spark.createDataFrame([("a", "2024-05-01"), ("b", None), (None, "bad"), ("c", "2025-01-01")], "k string, date string")
    keep = lambda f: [r.k for r in df.where(filters.metadata_match(f)).collect()]
    assert keep(None) == ["a", "b", None, "c"] and keep({"k": None}) == [None]
    assert keep({"k__in": ["a", "c"], "date_lte": "2024-12-31"}) == ["a"]
    assert keep({"date_gte": "2024-01-01"}) == ["a", "c"] and keep({"k__ne": "a"}) == ["b", None, "c"]


def brute_tokens(costs, most, overlap):
    out, a, used = [], 0, 0
    for i, c in enumerate(costs):
        if i > a and used + c > most:
            out.append((a, i))
            a = i - overlap if overlap and i - a >= overlap else i
            used = sum(costs[a:i])
        used += c
    return out + ([(a, len(costs))] if costs else [])


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_token_spans(spark, overlap):
    rng = np.random.default_rng(overlap)
    for n in (0, 1, 5, 60):
        costs = rng.integers(1, 12, n).tolist()
        got = spark.createDataFrame([(costs,)], "c array<bigint>").select(chunking.token_spans(F.col("c"), 20, overlap)).first()[0]
        assert [tuple(x) for x in got] == brute_tokens(costs, 20, overlap)


def test_cohesive_breaks():
    encode = lambda ts: np.array([[1.0, 0] if "x" in t else [0, 1.0] for t in ts])
    spans = chunking.cohesive(["x a", "x b", "y c", "y d"], [1, 1, 1, 2], encode, 100, 0.6, 0)
    assert [s[:2] for s in spans] == [(0, 2), (2, 3), (3, 4)]
    assert chunking.cohesive([], [], encode, 10, 0.5, 1) == []


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, at int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, 9, "c"), (2, 3, "d")], "k int, at int, v string")
    assert sorted(tuple(r) for r in joins.as_of(left, right, ["k"], "at", ["v"]).collect()) == [(1, 5, "a"), (1, 10, "c"), (2, 1, None)]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(map(tuple, store.upsert(old, new, "id").collect())) == [(1, "a"), (2, None), (3, "c")]
    assert [r.id for r in store.insert_only(old, new, "id").collect()] == [3]
    assert one(spark, store.slices(F.col("t"), 2), t="abcde") == ["ab", "cd", "e"] and one(spark, store.slices(F.col("t"), 2), t="") == []


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, "fish"), (4, None)], "id long, text string").fillna({"text": ""})
    q = spark.createDataFrame([(1, "bird"), (2, "")], "qid long, text string")
    got = sorted((r.qid, r["rank"], r.id) for r in retrieval.bm25(chunks, q, 2).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 2)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [2.0, 0.0])], "id long, vec array<double>")
    qv = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, vec array<double>")
    near = retrieval.dense(v, qv, 3)
    assert [(r.id, r["rank"]) for r in near.orderBy("rank").collect()] == [(1, 1), (4, 2), (2, 3)]
    fused = retrieval.rrf([near, near.where("id = 2")]).orderBy("rank").collect()
    assert fused[0].id == 2 and fused[0].score == pytest.approx(1 / 63 + 1 / 63)
    cand = near.join(v, "id").join(qv.withColumnRenamed("vec", "qvec"), "qid")
    assert [r.id for r in retrieval.mmr(cand, 2, 0.5).orderBy("place").collect()][0] == 1
    assert retrieval.dense(v.limit(0), qv, 3).count() == 0 and retrieval.dense(v, qv.limit(0), 3).count() == 0


def test_retrieve(spark):
    texts = ["cat dog. fish swim", "cat cat bird. Old bird sings", "fish", "bird of the sea. A cat", "cat"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(5)], "id long, vec array<double>")
    queries = spark.createDataFrame([(1, "bird", [1.0, 0.0]), (2, "cat", [1.0, 0.4])], "qid long, text string, vec array<double>")
    plain = retrieval.retrieve(vectors, chunks, queries, 3).collect()
    assert sorted((r.qid, r["rank"]) for r in plain) == [(q, n) for q in (1, 2) for n in (1, 2, 3)] and sorted((r.qid, r.place) for r in plain) == [(q, n) for q in (1, 2) for n in (1, 2, 3)]
    for q, word in ((1, "bird"), (2, "cat")):
        own = sorted((r for r in plain if r.qid == q), key=lambda r: r["rank"])
        want = [2.0 * math.log1p(texts[r.id].count(word)) / math.log(max(20, len(texts[r.id]))) for r in own]
        assert [r.score for r in own] == pytest.approx(want) and want == sorted(want, reverse=True)
        assert all(word in r.summary.lower() for r in own if word in texts[r.id])
    long = retrieval.retrieve(vectors, chunks, queries, 3, scorer=lambda pairs: [float(len(t)) for _, t in pairs]).collect()
    assert {(r.qid, r.id) for r in long} == {(r.qid, r.id) for r in plain} and all(r.score == len(texts[r.id]) for r in long)
    assert [r.score for r in sorted(long, key=lambda r: (r.qid, r["rank"]))] == [x for q in (1, 2) for x in sorted((r.score for r in long if r.qid == q), reverse=True)]
    assert retrieval.retrieve(vectors, chunks, queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 3, 4])
def test_near_pairs_against_all(spark, blocks):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 12)]
    rows = []
    for b in base:
        for _ in range(6):
            x = b
            for k in rng.choice(64, rng.integers(0, 11), replace=False):
                x ^= 1 << int(k)
            rows.append((len(rows), x - 2**64 if x >= 2**63 else x if x >= -(2**63) else x + 2**64))
    got = {tuple(r) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, simhash long"), "id", 8, blocks).collect()}
    ham = lambda x, y: ((x ^ y) % 2**64).bit_count()
    assert got == {(a, b, ham(x, y)) for a, x in rows for b, y in rows if a < b and ham(x, y) <= 8}


def test_near_links_of_copies(spark):
    far = 0x5555555555555555
    rows = [(1, 0), (2, 0), (3, 0), (4, 7), (5, 7), (6, far), (7, -1), (8, -1), (9, (1 << 12) - 1)]
    hashes = spark.createDataFrame(rows, "id long, simhash long")
    got = sorted(tuple(r) for r in dedup.near_links(hashes, "id").collect())
    assert got == [(1, 2, 0), (1, 3, 0), (1, 4, 3), (4, 5, 0), (7, 8, 0)]
    assert {r.id: r.leader for r in dedup.leader_of(hashes, "id").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    assert dedup.near_links(hashes.limit(0), "id").count() == 0 and dedup.leader_of(hashes.limit(0), "id").count() == 0
    assert [dedup.kept_blocks(n, 8) for n in (0, 10, 10**4, 10**5, 10**9)] == [1, 1, 2, 3, 4]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 41)], "a long, b long")
    got = {r.id: r.root for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40, 50: 40}
    assert graph.components(edges.limit(0)).count() == 0


def test_simhash_of_short_texts(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "a b c"), (3, "A  b c")], "id long, text string")
    got = {r.id: r.simhash for r in dedup.simhash(df.select("id", F.explode(dedup.ngrams(F.col("text"))).alias("term")), "id").collect()}
    assert set(got) == {2, 3} and got[2] == got[3]


def test_pack_and_answer(spark):
    hits = spark.createDataFrame([(1, 10, 1, 5, 0.9, "First one. Shared line."), (1, 11, 2, 6, 0.5, "Shared line. Second one."), (1, 12, 3, 6, 0.1, "shared LINE.")], "qid long, id long, rank long, doc_id long, score double, text string")
    packed = answers.pack(answers.quotas(hits), 100).orderBy("source").collect()
    assert [(r.source, r.id, r.body) for r in packed] == [(1, 10, "First one. Shared line."), (2, 11, "Shared line. Second one.")]
    text = answers.answer(answers.pack(answers.quotas(hits), 100)).first()
    assert text.answer.endswith("[2]") and "[1,2]" in text.answer and text.sources == 2
    assert answers.numeric_conflict(hits.withColumn("text", F.concat("text", F.lit(" 10 and 20")))).first().conflict
    assert answers.grounding(hits).first().sufficient


def test_rules(spark):
    assert one(spark, rules.rewrite(F.col("t")), t="Hello, please. Tell me about pension loss of the company company?") == "pension loss of company"
    assert one(spark, rules.intent(F.col("t"))["intent"], t="Ich will beantragen: Antrag") == "application"
    assert one(spark, rules.risk(F.col("a"), F.col("b"), F.col("c")), a="Pilot", b="", c="Ski") == 5
    p = one(spark, rules.softmax(F.col("x")), x=[1000.0, 1000.0, 0.0])
    assert p[0] == pytest.approx(0.5) and sum(p) == pytest.approx(1)


def test_vectors_in_slices_of_bounded_bytes(spark):
    """A long text among many short ones neither widens the others nor makes a slice with them."""
    import pyarrow as pa

    texts = ["a b", None, "a b", "x " * 200_000, "", "c"] * 3
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(chunking.slices(batch, "text", rows=4, size=100))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 100) for p in parts)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.vec for r in chunking.with_vectors(frame, "text", chunking.hashing_embedder(8)).collect()}
    want = chunking.hashing_embedder(8)([t or "" for t in texts])
    assert [got[i] for i in range(len(texts))] == want.tolist()
    assert chunking.with_vectors(frame.where("id < 0"), "text", chunking.hashing_embedder(8)).count() == 0


def test_weighted_votes_go_by_document_once(spark):
    """Votes of weighted terms against plain sums, with a null key, keys over several batches and ties; no row of 64 sums is shuffled."""
    import hashlib
    import random

    rng = random.Random(3)
    rows = [(i if i < 5 else None, f"t{rng.randrange(400)}", rng.choice([0.5, 1.25, 2.0])) for i in range(6) for _ in range(2500 * (i % 3) + 2)]
    rows += [(9, "x", 1.0), (9, "x", -1.0)]
    for strict in (True, False):
        want = {}
        for key, term, w in rows:
            h = int(hashlib.md5(term.encode()).hexdigest()[:16], 16)
            v = want.setdefault(key, [0.0] * 64)
            for b in range(64):
                v[b] += w if h >> b & 1 else -w
        frame = dedup.simhash(spark.createDataFrame(rows, "id long, term string, w double"), "id", F.col("w"), strict)
        got = {r.id: r.simhash % 2**64 for r in frame.collect()}
        assert got == {k: sum(1 << b for b, x in enumerate(v) if (x > 0 if strict else x >= 0)) for k, v in want.items()}
    assert "HashAggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_term_weight_of_odd_spaces(spark):
    terms = [("lange wörter\there", 1.0), ("versicherungen  12 %", 1.3 * 1.3), ("", 1.0), ("  \n ", 1.0), ("Haftung haftung", 2.0 * 1.35), ("abcdefgh", 1.4)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t, _ in terms], "t string").select(dedup.term_weight(F.col("t"))).collect()]
    old = lambda t, base: base * (1 + m * 0.05 if (w := t.split()) and (m := sum(map(len, w)) / len(w)) > 6 else 1)
    assert got == pytest.approx([old(t, b) for t, b in zip([t for t, _ in terms], [1, 1.3 * 1.3, 1, 1, 2.0, 1], strict=True)])
