import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline as cp
from spindrift.llm import langid, mixing, simhash
from spindrift.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(rows):
    """Group of each row by exact Jaccard similarity of 0.8 over all pairs."""
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                group[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def check_dedup(spark, rows):
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n long, id string")
    kept = [(r.doc_id, r.text) for r in cp.near_dedup(spark, df, SF).collect()]
    assert len(kept) == len(set(kept))
    groups = brute_groups(rows)
    left = Counter(g for g in groups)
    per = Counter(groups[rows.index(k)] for k in kept)
    assert set(per) == set(left) and set(per.values()) == {1}
    for k in kept:
        ids = [rows[i][0] for i, g in enumerate(groups) if g == groups[rows.index(k)] and rows[i][0] is not None]
        assert k[0] == min(ids, default=None)


def test_dedup_of_varied_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (5, 8, 14, 40, 150, 700):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(n)]
            for changes in (0, 0, 1, 2, n // 40, n // 25):
                w = list(base)
                for _ in range(changes):
                    w[rng.randrange(n)] = rng.choice(words)
                rows.append((len(rows), " ".join(w)))
            rows.append((len(rows), " ".join([*base, "tail"])))
    rows += [(900, None), (901, ""), (902, " \n"), (900, None), (None, "five words are right here"), (None, rows[0][1]), (903, "a"), (904, "A")]
    check_dedup(spark, rows)


def test_dedup_of_one_large_group(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(5)):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check_dedup(spark, rows)


def test_dedup_of_documents(spark):
    check_dedup(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_language_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12345 --", "en", "s", 8), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    kept = cp.language(spark, docs.unionByName(extra), SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_decontamination(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(5, "clean words only", None, None, None), (None, "so " + items[0] + " on", None, None, None), (None, None, None, None, None)], docs.schema)
    kept = cp.decontaminate(spark, docs.unionByName(extra), SF).collect()
    texts = [r.text for r in kept]
    assert "clean words only" in texts and None in texts
    assert not any(x in t for t in texts if t for x in items)
    leaked = {r.doc_id for r in docs.collect() if any(x in r.text for x in items)}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept} == leaked


def test_mix_follows_the_words_taken(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.taken(docs).collect()
    got = Counter(r.doc_id for r in cp.mix(spark, docs, sf).collect())
    assert all(int(r.taken / r["size"]) <= got[r.doc_id] <= -int(-r.taken // r["size"]) for r in rows if r["size"])
    total, want = Counter(), {}
    for r in rows:
        total[r.source] += got[r.doc_id] * r["size"]
        want[r.source] = r.target
    assert abs(sum(total.values()) - sum(want.values())) < 0.05 * sum(want.values())
    assert all(abs(total[s] - t) < 0.35 * t for s, t in want.items())


def test_run(spark):
    got = cp.run(spark, SF).toPandas()
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    known = {}
    for name, stage in cp.STAGES[:4]:
        after = scratch.save(stage(spark, docs, SF))
        assert after.columns == docs.columns
        known[name] = after.count()
        docs = after
    assert known["language_id"] >= known["near_dedup"] > known["decontaminate"] > 0
    rows = docs.collect()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in rows)
    size = {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in rows}
    assert all((r.size, r.text_crc32) == size[r.doc_id] for r in got.itertuples())
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    more = docs.selectExpr("*", "1 as found", "2 as gone_id", "3 as took_id", "4 as took_key", "5 as row", "6 as size", "7 as part", "8 as k", "9 as f0", "10 as id", "11 as text_key", "12 as shard", "13 as times")
    for name, stage in cp.STAGES[:4]:
        got = stage(spark, more, SF)
        assert got.columns == more.columns, name
        assert all((r.found, r.gone_id, r.took_id, r.size, r.id, r.text_key) == (1, 2, 3, 6, 10, 11) for r in got.collect())
    assert cp.shard(spark, more, SF).count() == 40


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_candidates_lose_no_pair_over_the_threshold():
    """Sets of similarity 0.80 to 0.82, of many sizes: how many share a key, and how many fingerprints are near enough."""
    rng = random.Random(8)
    pairs = missed = far = 0
    for n in (5, 6, 9, 14, 30, 60, 79, 95, 130, 300, 760, 1500):
        for _ in range(60 if n < 500 else 20):
            gone = int(n * (1 - 0.8) / (1 + 0.8) + 1e-9) if n > 6 else 1 if rng.random() < 0.5 else 0
            words = [f"w{rng.getrandbits(40)}" for _ in range(n + gone + 4)]
            a = {" ".join(words[i : i + 5]) for i in range(n)}
            b = {" ".join(words[i : i + 5]) for i in range(gone, n)} if n <= 6 else set(list(a)[: n - gone]) | {f"x{rng.getrandbits(40)} {i}" for i in range(gone)}
            if len(a & b) < 0.8 * len(a | b) - 1e-9:
                continue
            found = [simhash.sketch_of(np.array([xxhash.xxh64_intdigest(x, 42) for x in s], np.uint64)) for s in (a, b)]
            keys = [{(k, i, v) for k, level in f[3] for i, v in enumerate(level) if v} for f in found]
            apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(found[0][0], found[1][0], strict=True))
            pairs, missed, far = pairs + 1, missed + (not keys[0] & keys[1]), far + (apart > simhash.APART)
    assert pairs > 400 and far == 0 and missed <= 0.002 * pairs
    assert langid.UND == "und"
