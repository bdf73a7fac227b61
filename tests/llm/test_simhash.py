import re

import xxhash
from pyspark.sql import functions as F

from spindrift.llm import simhash, words


def brute_print(text, width=3):
    seq = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(seq[i : i + width]) for i in range(len(seq) - width + 1)] or ([" ".join(seq)] if seq else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, prints[i], least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows, schema="doc_id long, text string"):
    found = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r[0], r[1] % 2**64, r[2]) for r in found), key=str)


def test_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "One two"), (2, "one TWO"), (4, base), (6, base + " x"), (7, base), (7, base), (8, "É Éé ÀB"), (None, base), (None, "alone here now"), (10, base.replace("w150 ", "q "))]
    assert result(spark, rows) == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, f0 long, key long")
    assert simhash.near_duplicates(df).count() == 1


def test_links_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    seen = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            seen.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    values = sorted(simhash._signed(x) for x in seen)
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "f0 long")).collect()
    assert {tuple(r) for r in got} == want


def test_blocks_of_words():
    text = "Aa bb\tcc  dd\n" + "e" * 50 + " ff Ég"
    whole = [bytes(x) for part in words.shingles(text, 3) for x in part]
    for block in (1, 3, 7, 20):
        assert [bytes(x) for part in words.shingles(text, 3, block) for x in part] == whole
    assert [bytes(x) for part in words.shingles("a b", 3) for x in part] == [b"a b"]
    assert list(words.shingles("  ", 3)) == []


def test_parity_spares_only_pairs_under_the_similarity(spark):
    import random

    rng = random.Random(4)
    rows = []
    for n in (1, 2, 5, 9, 60, 200, 900, 5000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(12):
            share = rng.random() * 0.12
            rows.append((len(rows), 0, " ".join(w if rng.random() > share else f"v{rng.randrange(10**6)}" for w in base)))
    sets = simhash.shingle_sets(spark.createDataFrame(rows, "doc_id long, text_key long, text string"), 5).cache()
    a, b = sets.alias("a"), sets.alias("b")
    found = a.join(b, (F.col("a.doc_id") < F.col("b.doc_id")) & (F.floor(F.col("a.doc_id") / 12) == F.floor(F.col("b.doc_id") / 12)))
    flags = found.select(simhash.may_be_alike("a", "b", 0.8).alias("may"), simhash.alike(F.col("a.members"), F.col("b.members"), 0.8).alias("is")).collect()
    assert all(f["may"] for f in flags if f["is"])
    assert sum(f["is"] for f in flags) > 40 and sum(not f["may"] for f in flags) > 200


def test_pivots_of_the_stage_discard_only_what_is_far(spark):
    """Members of a large group are told from other texts by pivot distances alone; no pair within the radius goes."""
    import random

    rng = random.Random(9)
    rows, group = [], [rng.getrandbits(64) for _ in range(4)]
    for i in range(160):
        x = list(group) if i < 80 else [rng.getrandbits(64) for _ in range(4)]
        for _ in range(rng.randrange(60) if i % 80 else 0):
            x[rng.randrange(4)] ^= 1 << rng.randrange(64)
        rows.append((i, 1000 if i == 0 else 1, 10, *map(simhash._signed, x)))
    classes = simhash.with_pivots(spark.createDataFrame(rows, "id long, rows long, n long, f0 long, f1 long, f2 long, f3 long"))
    a, b = classes.alias("a"), classes.alias("b")
    apart = simhash._bits_apart([F.col(f"a.f{i}") for i in range(4)], [F.col(f"b.f{i}") for i in range(4)])
    kept = simhash.within(F.col("a.pivot"), F.col("b.pivot"), simhash.APART // simhash.STEP)
    found = a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id"), F.col("b.id"), kept, apart, simhash._near(0.8)).collect()
    assert all(k for _, _, k, d, _ in found if d <= simhash.APART) and all(near == (d <= simhash.APART) for *_, d, near in found)
    across = [k for x, y, k, _, _ in found if x < 80 <= y]
    assert sum(not k for k in across) > len(across) // 4
    assert sum(d <= simhash.APART for *_, d, _ in found) > 1000


def test_only_shared_keys_bring_their_fingerprints(spark):
    """Pipeline: keys of one class alone go no further than one shuffle of numbers."""
    from spindrift.llm.scratch import Scratch

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:200]), " ".join(words[:195]), " ".join(words[200:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "keys")
    classes = simhash.sketches(docs).select(F.col("doc_id").alias("id"), "n", "levels", F.lit(1).alias("rows"), *(f"f{i}" for i in range(4)))
    found = simhash.shared_keys(classes, scratch)
    held = {}
    for r in found.collect():
        held.setdefault(r.key, set()).add(r.id)
    assert held and all(ids == {0, 1} for ids in held.values())
    assert [tuple(r) for r in simhash.star_pairs(found, 0.8).collect()] == [(0, 1)]
