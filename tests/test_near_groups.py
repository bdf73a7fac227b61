"""Components, leaders and followers of near hashes against comparisons of all pairs, and the links that dense groups take."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spindrift.operators import dedup
from spindrift.plans import registry

SIGNED = lambda h: h - (1 << 64) if h >> 63 else h


def rows_of(seed, centres=6, each=25, flips=7):
    """Hashes around centres, a chain of ids in the order of the chain, and lone ones; ids are shuffled but for the chain's."""
    rng = random.Random(seed)
    found = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        found += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips))) for _ in range(each)]
    found += [rng.getrandbits(64) for _ in range(30)]
    found = list(dict.fromkeys(found))
    rng.shuffle(found)
    chain = [rng.getrandbits(64)]
    while len(chain) < 40:
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 7)))
    return list(enumerate(h for h in [*found, *dict.fromkeys(chain)]))


def near(x, y):
    return (x ^ y).bit_count() <= 8


def brute_roots(rows, linked=near):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    touched = set()
    for i, x in rows:
        for j, y in rows[:i]:
            if linked(x, y):
                touched |= {i, j}
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in touched}


def brute_leaders(rows):
    led, out = [], {}
    for i, x in rows:
        first = next((j for j, y in led if near(x, y)), i)
        if first == i:
            led.append((i, x))
        out[i] = first
    return {i: out[i] for i in brute_roots(rows)}


def frame(spark, rows):
    return spark.createDataFrame([(i, SIGNED(h)) for i, h in rows], "id long, simhash long").repartition(5)


def test_components_leaders_and_followers_equal_brute_force(spark):
    rows = rows_of(3)
    df = frame(spark, rows)
    assert {r.id: r.root for r in dedup.near_components(df).collect()} == brute_roots(rows)
    want = brute_leaders(rows)
    assert len(set(want.values())) > 15
    for together in (dedup.TOGETHER, 15):  # at 15, a component has several ranges of ids
        got = dedup.leaders(df, together=together).collect()
        assert len(got) == len(want) and {r.id: r.leader for r in got} == want
    late = sorted(i for i, x in rows if any(near(x, y) for j, y in rows[:i]))
    assert sorted(r.id for r in dedup.followers(df, "id").collect()) == late


def test_a_link_may_need_more_than_nearness(spark):
    rows = rows_of(4, 3, 20)
    parity = lambda p: p.where((F.col("a") + F.col("b")) % 3 != 0)
    index = {h: i for i, h in rows}
    want = brute_roots(rows, lambda x, y: near(x, y) and (index[x] + index[y]) % 3 != 0)
    assert {r.id: r.root for r in dedup.near_components(frame(spark, rows), linked=parity).collect()} == want


def test_copies_empty_and_null_hashes(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (9, 2**62 - 1), (10, None), (11, None)], "doc long, simhash long")
    assert sorted(r.id for r in dedup.followers(df, "doc").collect()) == [2, 3]
    assert {r.id: r.leader for r in dedup.leader_of(df, "doc").collect()} == {1: 1, 2: 1, 3: 1}
    empty = df.limit(0)
    assert dedup.followers(empty, "doc").count() == dedup.leader_of(empty, "doc").count() == 0


def test_a_dense_group_takes_links_as_many_as_its_rows(spark):
    """Four thousand hashes within two bits of one: eight million near pairs, of which few are looked at."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    some = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(12) for b in range(a) for c in range(64)}
    rows = list(enumerate(sorted(some)[:4000]))
    seen = spark.sparkContext.accumulator(0)

    def counted(pairs):
        seen.add(pairs.count())
        return pairs

    df = frame(spark, rows)
    roots = {r.root for r in dedup.near_components(df, linked=counted).collect()}
    assert roots == {0} and seen.value < 2 * 45 * len(rows)
    assert dedup.leaders(df).where("leader = id").count() == len(set(brute_leaders_dense(rows).values()))


def brute_leaders_dense(rows):
    led, out = [], {}
    for i, x in rows:
        out[i] = next((j for j, y in led if near(x, y)), i)
        if out[i] == i:
            led.append((i, x))
    return out


def test_run_hashes_are_those_of_single_runs_and_made_where_the_row_is(spark, monkeypatch):
    """hashes of whole rows, of long texts in pieces too, equal the votes of exploded runs; no row goes out for a run."""
    odd = ["one two three", "One\ttwo\n\x0bTHREE\x0c four\r", " lead   İstanbul ΟΔΟΣ straße  x y ", "a b", "", "   ", None, "x" * 50 + " y " + "z" * 50, "end of piece " * 40, "\x1c a \x1c b \x85 c d"]
    docs = spark.createDataFrame([*enumerate(odd), (0, "four five six seven"), (None, "no id at all here")], "doc_id long, text string").repartition(3)
    want = dedup.simhash(docs.select("doc_id", F.explode(dedup.ngrams(F.col("text"))).alias("term")), "doc_id")
    found = dedup.ngram_simhash(docs, "doc_id", F.col("text"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    for piece in (1, 7, 13, 64):
        monkeypatch.setattr(dedup, "PIECE", piece)
        for t in filter(None, odd):
            w = t.lower().encode().split()
            assert sum(dedup._runs(t.lower().encode(), 3), []) == [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]


def test_keys_are_compared_in_numbers_whatever_the_batches(spark, monkeypatch):
    """a key that crosses batches is whole, and rows of joined keys are shuffled once for pairs and once each for the ends and the rest of components."""
    rows = rows_of(6, 4, 20)
    want = {(i, j) for j, y in rows for i, x in rows[:j] if near(x, y)}
    label = dict(brute_roots(rows, lambda x, y: near(x, y) and (x ^ y) & 1))
    ordered = dedup.keyed(frame(spark, rows), 8, 2).toPandas().sort_values(["choice", "part", "id"])
    ordered["root"] = [label.get(i, i) for i in ordered["id"]]
    for size, step in ((1, 1), (5, 3), (200_000, 1000), (10, 10_000)):
        monkeypatch.setattr(dedup, "AT_ONCE", size)
        monkeypatch.setattr(dedup, "PAIRS", step)
        batches = [pa.RecordBatch.from_pandas(ordered[at : at + step], preserve_index=False) for at in range(0, len(ordered), step)]
        given = lambda kind: [(r["x"], r["y"]) for b in dedup._matches(8, 2, kind)(iter(batches)) for r in b.to_pylist()]  # noqa: E731, B023
        assert len(found := given("all")) == len(want) and set(found) == want
        apart = {(i, j) for i, j in want if label.get(i, i) != label.get(j, j)}
        assert {tuple(sorted(p)) for p in given("rooted")} == apart and len(given("rooted")) == len(apart)
        assert set(given("ends")) <= want
    plan = dedup.near_pairs(frame(spark, rows), "id", 8, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def keyed_batches(spark, rows, blocks, step=1000, **more):
    ordered = dedup.keyed(frame(spark, rows), 8, blocks).toPandas().sort_values(["choice", "part", "id"])
    for name, of in more.items():
        ordered[name] = [of(i) for i in ordered["id"]]
    return [pa.RecordBatch.from_pandas(ordered[at : at + step], preserve_index=False) for at in range(0, len(ordered), step)]


def test_f1_a_key_gives_fewer_links_than_rows_and_features_are_compared_in_the_task(spark):
    """near rows of one key come out connected, not as all their pairs, which a plan took for a small table; what fails the features is not given out at all."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    rows = list(enumerate({centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(400)}))
    batches = keyed_batches(spark, rows, 1, f=lambda i: [float(i % 2), 1.0])
    for alike, linked in ((None, near), (lambda a, b, d: (a[:, 0] == 1) & (b[:, 0] == 1), lambda x, y: near(x, y) and index[x] % 2 == index[y] % 2 == 1)):
        index = {h: i for i, h in rows}
        found = [(r["x"], r["y"]) for b in dedup._matches(8, 1, "joined", alike)(iter(batches)) for r in b.to_pylist()]
        assert len(found) < 9 * len(rows)
        made = spark.createDataFrame([(i, SIGNED(h), [float(i % 2), 1.0]) for i, h in rows], "id long, simhash long, f array<double>")
        assert {r.id: r.root for r in dedup.near_components(made, alike=alike).collect()} == brute_roots(rows, linked)


def test_f1_clusters_of_a_table_with_texts_without_words(spark, tmp_path):
    """a text without words has no densities, which was an error; clusters are those of all pairs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", " \n ", None, "a", "one two"]
    for _ in range(25):
        long = rng.sample(words, 300)
        texts += [" ".join(long), " ".join(long), " ".join([*long[:-1], "klausel"]), " ".join(long[1:]), "klausel! " * 150 + " ".join(long)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["dedup_clusters"](spark, str(tmp_path)).collect()
    hashes = {r.doc_id: r.simhash & (2**64 - 1) for r in dedup.ngram_simhash(docs, "doc_id", F.col("text")).collect()}
    made = dedup.features(F.col("text"))
    f = {r.doc_id: np.array([r.f], float) for r in docs.select("doc_id", F.array(*made.values()).alias("f")).collect()}
    telling = [list(made).index(x) for x in ("legal_terms_density", "insurance_benefits_density", "semantic_complexity")]
    score = lambda i, j, d: 0.7 * (1 - d / 64) + 0.3 * dedup.feature_similarity(f[i], f[j], telling)[0]
    want = {}
    ids, root = sorted(hashes), {i: i for i in hashes}
    for i in ids:
        for j in ids:
            d = (hashes[i] ^ hashes[j]).bit_count()
            if i < j and d <= 8 and round(score(i, j, d), 9) >= 0.85 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    for r in root.values():
        want[r] = want.get(r, 0) + 1
    assert {r.root: r.members for r in got} == {r: n for r, n in want.items() if n > 1} and len(got) >= 25
    assert registry.QUERIES["semantic_features"](spark, str(tmp_path)).where("word_count = 0").count() == 2


def test_f3_late_and_taken_rows_of_keys_equal_brute_force(spark):
    """rows with an earlier near one, and the first leader near a row, are found where a key's rows are, not by joins of all keys."""
    rows = rows_of(9, 4, 30)
    late = {i for i, x in rows if any(near(x, y) for j, y in rows[:i])}
    leads = {i for i, _ in rows if i % 7 == 0}
    taker = {i: min(j for j, y in rows if j in leads and near(x, y)) for i, x in rows if i not in leads and any(near(x, y) for j, y in rows if j in leads)}
    batches = keyed_batches(spark, rows, 2, 300, leads=lambda i: i in leads)
    found = lambda kind: [(r["x"], r["y"]) for b in dedup._matches(8, 2, kind)(iter(batches)) for r in b.to_pylist()]
    assert {x for x, _ in found("late")} == late and all(y < x for x, y in found("late"))
    got = {}
    for x, y in found("taken"):
        got[x] = min(y, got.get(x, y))
    assert got == taker
    plan = dedup.followers(frame(spark, rows), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # members with the ids of their classes


def test_f3_leaders_and_components_broadcast_nothing(spark, monkeypatch):
    """no join of nodes or members goes through the driver, however small its tables look."""
    rows = rows_of(10, 3, 20)
    plans = []
    plain = type(spark.range(0)).checkpoint

    def kept(df, *a, **b):
        done = plain(df, *a, **b)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(type(spark.range(0)), "checkpoint", kept)
    found = dedup.leader_of(frame(spark, rows), "id")
    assert {r.id: r.leader for r in found.collect()} == brute_leaders(rows)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_f2_weighted_hashes_shuffle_texts_once_and_no_terms(spark, monkeypatch):
    """hashes equal the votes of exploded terms; terms and weights made in Python equal the columns'; small parts and ranges give the same."""
    rng = random.Random(11)
    some = "versicherung klausel Haftung nicht ohne zahlung_3 §4 12 123 %%% 45% 100€ $5 the and wörter straße İstanbul ΟΔΟΣ x² ½nicht nicht½ 一 nichts deckung, schutz. a-b end! ٣٤٥ nicht٣ Ⅷ klausel-Ⅷ versicherungen sehrlangeswortohneende u00a0\u00a0x".split(" ")
    texts = ["", " ", "\n", None, "the and", "ab", "klausel", " §§ ", "one two", "nicht nicht nicht nicht", "abcdefghijklmnopqrstuvwxyz " * 2]
    texts += [" ".join(rng.choices(some, k=rng.randrange(1, 60))) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (7, "klausel zwei drei vier"), (None, "no id at all here")], "doc_id long, text string").repartition(3)
    made = docs.where("text is not null").select(dedup.T.normalise(F.col("text")).alias("bare"), dedup.weighted_terms(F.col("text")).alias("g"))
    for r in made.select("bare", "g", F.transform("g", dedup.term_weight).alias("w")).collect():
        assert dedup.weighed(r.bare, {}) == dict(zip(r.g, r.w, strict=True)) and len(set(r.g)) == len(r.g)
        assert [dedup.weight_of(t)[1] for t in r.g] == r.w
    terms = docs.select("doc_id", F.explode(dedup.weighted_terms(F.col("text"))).alias("term"))
    known = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log(F.lit(docs.count()) / (F.col("df") + 1.0)) * dedup.term_weight(F.col("term"))).alias("w"))
    want = sorted(map(tuple, dedup.simhash(terms.join(known, "term"), "doc_id", F.col("w"), strict=True).collect()), key=str)
    for part, votes in ((8 << 20, 50_000), (500, 7)):
        monkeypatch.setattr(dedup, "PART_BYTES", part)
        monkeypatch.setattr(dedup, "RANGE_TERMS", part)
        monkeypatch.setattr(dedup, "VOTES", votes)
        found = dedup.idf_simhash(docs, "doc_id", F.col("text"))
        assert sorted(map(tuple, found.collect()), key=str) == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate" not in plan and "ReusedExchange" in plan
    assert dedup.idf_simhash(docs.limit(0), "doc_id", F.col("text")).count() == 0
