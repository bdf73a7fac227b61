import math
import struct
import zlib

import pytest
import xxhash

from spindrift.llm import kdshard


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = kdshard.shard(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(got.doc_id) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.itertuples())
    home = {}
    assert all(home.setdefault(texts[r.doc_id], r.shard) == r.shard for r in got.itertuples())
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() < 1.05 * sums.min()
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    again = kdshard.shard(docs).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_edges(spark):
    rows = [(1, None, None, 3), (2, "", "s", 3), (3, "é", None, 3), (3, "é", None, 3), (None, "zz", "s", 3), (5, "y" * 5000, "t", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = kdshard.shard(df, 3).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    assert len({r.shard for r in got if r.size == 3 and r.doc_id == 3}) == 1
    assert kdshard.shard(df.limit(0)).count() == 0
    assert kdshard.shards_for(kdshard.items(df), 1000) == 6
    assert {r.shard for r in kdshard.shard(df, 1).collect()} == {0}


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs and (as 1-tuples) ints, signed."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def brute_shards(rows, shards):
    """Shard of each text: the tree node by node, in lists."""
    unit = lambda x: 0.0 if x is None else spark_hash(x) % (1 << 20) / (1 << 20)
    points = {}
    for text, source, lang in rows:
        size = len((text or "").encode()) + 1
        g, c = spark_hash(text or ""), (unit(source), unit(lang), math.log2(size) / 40.0)
        w, had = points.get(g, (0, c))
        points[g] = (w + size, tuple(map(min, c, had)))
    spread = [max(max(c[i] for _, c in points.values()) - min(c[i] for _, c in points.values()), 1e-12) for i in range(3)]
    home = {}

    def first(sums, goal):
        total = 0
        for at in sorted(sums):
            if total + sums[at] >= goal:
                return at, total, sums[at]
            total += sums[at]

    def split(own, low_shard, k, level):
        if k == 1:
            home.update(dict.fromkeys(own, low_shard))
            return
        if not own:
            return
        low = [min(points[g][1][i] for g in own) for i in range(3)]
        wide = [max(points[g][1][i] for g in own) - low[i] for i in range(3)]
        dim = max(range(3), key=lambda i: (wide[i] / spread[i], -i))
        goal = sum(points[g][0] for g in own) * (k // 2) / k
        bins = {g: math.floor((points[g][1][dim] - low[dim]) / wide[dim] * (kdshard.BINS - 1)) if wide[dim] > 0 else 0 for g in own}
        sums = {}
        for g in own:
            sums[bins[g]] = sums.get(bins[g], 0) + points[g][0]
        cut, before, _ = first(sums, goal)
        rest, choice = goal - before, []
        for salt in range(kdshard.HASHES):
            inside = {}
            for g in own:
                if bins[g] == cut:
                    bucket = spark_hash((level,), (salt,), g) % kdshard.BUCKETS
                    inside[bucket] = inside.get(bucket, 0) + points[g][0]
            at, b, w = first(inside, rest)
            over, under = b + w - rest, rest - b
            choice.append((min(over, under), salt, at if over <= under else at - 1))
        _, salt, last = min(choice)
        left = [g for g in own if bins[g] < cut or bins[g] == cut and spark_hash((level,), (salt,), g) % kdshard.BUCKETS <= last]
        split(left, low_shard, k // 2, level + 1)
        split([g for g in own if g not in set(left)], low_shard + k // 2, k - k // 2, level + 1)

    split(list(points), 0, shards, 0)
    return {text: home[spark_hash(text or "")] for text, _, _ in rows}


@pytest.mark.parametrize("shards", [8, 5])
def test_against_a_tree_in_lists(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.source, r.lang) for r in docs.collect()] + [(None, None, "x"), ("", "s", None), ("twice", "a", "b"), ("twice", "c", "d")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string")
    want = brute_shards(rows, shards)
    got = {r.doc_id: r.shard for r in kdshard.shard(df, shards).collect()}
    assert [got[i] for i in range(len(rows))] == [want[t] for t, _, _ in rows] and len(set(got.values())) == shards


def test_place_keeps_rows_and_columns(spark):
    rows = [(1, "a b", "s", 9, 7), (1, "a b", "s", 9, 8), (None, None, None, 9, 6), (3, "c " * 400_000, "t", 9, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, n int")
    got = kdshard.place(df, 2).collect()
    assert sorted((str(r.doc_id), r.n, r.size) for r in got) == sorted((str(d), n, len(t or "") + 1) for d, t, _, _, n in rows)
    assert {r.shard for r in got} == {0, 1} and {(r.shard, r.slot) for r in got} == {(s, i) for s in (0, 1) for i in range(sum(r.shard == s for r in got))}
    assert kdshard.place(df.limit(0), 2).count() == 0
