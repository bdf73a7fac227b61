import itertools
import random
import re

import pytest

from spindrift.llm import decontam


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = set()
    for d, text in docs:
        a = toks(text)
        for i, item in items:
            b = toks(item)
            if not b:
                continue
            best = 0
            for start in range(-len(b) + 1, len(a)):
                s = 0
                for j in range(len(b)):
                    same = 0 <= start + j < len(a) and a[start + j] == b[j]
                    s = max(0, s + 1 if same else s + decontam.SUBSTITUTION)
                    best = max(best, s)
            if best >= min(decontam.LEAST, -(-len(b) * 8 // 10)):
                out.add((d, i))
    return out


def found(spark, docs, items, **kw):
    a = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, toks string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, key int")
    return [(r.doc_id, r.item_id) for r in decontam.overlaps(a, b, **kw).collect()]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_against_brute_force(spark, limit):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([3, 9, 12, 30, 60])))) for i in range(12)] + [(50, None), (51, "..."), (52, "One, two!")]
    docs = [(100, None), (101, ""), (102, "so ONE two three"), (103, " ".join(make(200)))]
    for i, t in items[:12]:
        w, body = t.split(), make(80)
        hurt = list(w)
        if len(w) >= 30:
            for k in range(7, len(w), 15):
                hurt[k] = "changed"
        docs += [(i, " ".join(body[:40] + w + body[40:])), (i + 200, " ".join(hurt).upper()), (i + 300, " ".join(w[len(w) // 2 :]))]
    docs.append(docs[-3])
    got = found(spark, docs, items, broadcast_seeds=limit)
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_every_qualifying_substitution_of_short_items(spark, limit):
    """Items of 1 to 20 tokens with up to two tokens changed, at all places, against the rule itself."""
    items, docs = [], []
    for n in range(1, 21):
        w = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(w)))
        for k in [(), *itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            docs.append((len(docs), " ".join(["before", *("x" if i in k else t for i, t in enumerate(w)), "after"][(len(docs) % 2) :])))
    want = {(d, n) for d, t in docs for n, i in items if f"i{n}w" in t for _ in brute([(d, t)], [(n, i)])}
    assert set(found(spark, docs, items, broadcast_seeds=limit)) == want


def test_masks_are_sure():
    assert decontam.sure_from(decontam.MASKS) == 7
    assert decontam.sure_from(("111",)) == 3 and decontam.sure_from(("1111",)) > decontam.LEAST
    rng = random.Random(5)
    for _ in range(3000):
        run = [rng.random() < 0.8 for _ in range(rng.randint(5, 40))]
        score = best = 0
        for same in run:
            score = max(0, score + (1 if same else decontam.SUBSTITUTION))
            best = max(best, score)
        hit = any(all(run[a + i] for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for a in range(len(run) - len(m) + 1))
        assert hit or best < 7


def test_long_texts_and_ties(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    long = [rng.choice(words) for _ in range(20_000)]
    items = [(1, " ".join(long[5000:5030])), (2, " ".join(long)), (3, "a b c d e f g h i j k l m n o")]
    twice = "a b c d e f g h i j k l m n o z " * 2
    df = spark.createDataFrame([(1, " ".join(long)), (2, twice), (2, twice)], "doc_id long, text string")
    for limit in (10**6, 0):
        got = decontam.overlaps(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=limit).collect()
        assert sorted(map(tuple, got)) == [(1, 1, 30, 30, 5000), (1, 2, 20_000, 20_000, 0), (2, 3, 15, 15, 0)]


def test_empty(spark):
    assert found(spark, [], [(1, "a b")]) == [] and found(spark, [(1, "a b")], []) == []


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = set(found(spark, docs, items))
    verbatim = {(d, i) for d, t in docs for i, x in items if x in t}
    assert verbatim and verbatim <= got
    assert all(set(zip(*[toks(dict(docs)[d])[k:] for k in range(6)])) & set(zip(*[toks(dict(items)[i])[k:] for k in range(6)])) for d, i in got)
