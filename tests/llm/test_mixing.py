import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    cap, target, free, left = {s: 2.0 * sizes[s] for s in order}, {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    return target


def check(spark, rows, block):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, block int")
    got = mixing.taken(df, block=block).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), words(t)) for d, t, _ in rows)
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + words(t)
    want = brute_targets(total)
    took = dict.fromkeys(total, 0)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        took[r.source] += r.taken
    for s in total:
        assert abs(took[s] - want[s]) <= 2 * block
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(df, block=block).collect()))
    mixed = mixing.mix(df, block=block).groupBy("doc_id").agg(F.sum("words").alias("w")).collect()
    assert {r.doc_id: r.w for r in mixed} == {d: w for d in {r[0] for r in rows} if (w := sum(r.taken for r in got if r.doc_id == d))}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text, r.source) for r in docs], 64)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y z w", None), (3, "x y z w", None), (4, "w " * 900, "b"), (5, "q", "é"), (6, "r s t", "null"), (None, "k l", "b"), (7, " \t\x0b", "a")]
    check(spark, rows, 4)
    assert mixing.taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    check(spark, [(1, None, None), (2, " ", "s")], 4)


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs and (as 1-tuples) ints, signed."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def brute_taken(rows, block, shards=mixing.SHARDS):
    """(taken, shards) of each row: every slot of every source, one by one."""
    key = lambda s: "" if s is None else "=" + s
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    want, took, into = brute_targets(total), [0] * len(rows), [set() for _ in rows]
    for s in total:
        blocks = -(-total[s] // block)
        quota = min(int(math.floor(want[s] * blocks / total[s] + 0.5)), 2 * blocks) if total[s] else 0
        mine = [(spark_hash(d, n) % mixing.PARTS, d, n, i) for i, (d, t, x) in enumerate(rows) if x == s for n in [size(t)]]
        at, places = 0, []
        for _, _, n, i in sorted(mine):
            places.append((at, n, i))
            at += n
        for slot in range(quota):
            turn, x = divmod(slot, blocks)
            for r in range(1, mixing.ROUNDS + 1):
                k = spark_hash((mixing.SEED,), key(s), turn, (r,)) % blocks
                other = (k - x) % blocks
                if spark_hash(k, max(x, other)) & 1:
                    x = other
            for at, n, i in places:
                words = min(at + n, (x + 1) * block) - max(at, x * block)
                if words > 0:
                    took[i] += words
                    into[i].add(spark_hash((mixing.SEED,), key(s), slot) % shards)
    return [(took[i], len(into[i])) for i in range(len(rows))]


def test_taken_against_every_slot(spark):
    """Blocks, permutations, draws and joins against a slot by slot version."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text[:3000], r.source if r.doc_id % 9 else None) for r in docs]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16).collect()
    assert {r.doc_id: (r.taken, r.shards) for r in got} == dict(zip([r[0] for r in rows], brute_taken(rows, 16), strict=True))
    assert len({r.taken for r in got}) > 20


def test_draws_follow_the_multinomial_law(spark):
    """Counts of a source over the output shards add up to its slots and spread as equal chances do."""
    rows = [(i, "w " * 40, f"s{i % 3}") for i in range(900)]
    found = mixing.draws(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=4, shards=32).collect()
    for k in ("=s0", "=s1", "=s2"):
        counts = [r.slots for r in found if r.k == k]
        n = sum(counts)
        assert n > 2000 and len(counts) == 32
        chi = sum((c - n / 32) ** 2 / (n / 32) for c in counts)
        assert 10 < chi < 62  # 0.0005 of either end for 31 degrees of freedom


def test_runs_sum_as_one(spark):
    from spindrift.llm.scratch import Scratch

    rows = spark.createDataFrame([(i * 37 % 101, float(i)) for i in range(101)], "a long, v double")
    for most in (7, 1000):
        got = mixing.before(rows, [F.col("a")], {"n": F.lit(1), "s": F.col("v")}, Scratch(spark, "t"), most).orderBy("a").collect()
        assert [r.n for r in got] == list(range(101)) and [r.s for r in got] == [sum(x.v for x in got[:i]) for i in range(101)]


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(n).cast("long"), F.lit("=s"), F.lit(1))).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))
