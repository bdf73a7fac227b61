"""SimHash near-duplicates by pivot distance tables.

Every fingerprint is described by its Hamming distances to fixed reference fingerprints (the
pivots): zero, and for each block of the 64 bits several pivots that differ from zero inside
that block only. By the triangle inequality no coordinate of two fingerprints differs by more than their
distance. So pairs whose largest coordinate difference exceeds the radius are discarded, and
the survivors are verified by their true distance. Candidates need no cross join: d(x, pivot) - d(x, zero)
changes only with bits inside the pivot's block, and `radius` differing bits leave at least
blocks - radius blocks alone, so linked fingerprints agree in all coordinates of some blocks, which are equi-join keys.

Nulls and texts without a word have fingerprint zero and are linked like any other. Repeated rows
keep their rows. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.arrow import lean
from spindrift.llm.components import components
from spindrift.llm.scratch import Scratch, listed
from spindrift.llm.words import shingles

BITS = 64
#: Blocks of the fingerprint, and pivots in each; 7 distances of a byte fit a long.
BLOCKS, PER_BLOCK = 4, 7
_ONES = 0x01010101010101
_HIGH, _LOW, _ABOVE = 0x80 * _ONES, 0x7F * _ONES, lambda r: (0x7F - 2 * r) * _ONES


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """Bits of a hash in each lane (rows: shingles): lane 0 is the hash, others are mixed from it."""
    out = np.empty((len(h), lanes), np.uint64)
    out[:, 0] = h
    with np.errstate(over="ignore"):
        for i in range(1, lanes):
            x = h + np.uint64(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, i] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: str | None, width: int = 3, lanes: int = 1, as_set: bool = False) -> list[int]:
    """Unsigned fingerprint words: a bit is set if it is in over half the shingles' XXH64 (seed 42)."""
    votes, n = np.zeros(BITS * lanes, np.int64), 0
    seen: set[int] = set()
    for part in shingles(text, width):
        values = [xxhash.xxh64_intdigest(x, 42) for x in part]
        if as_set:
            fresh = set(values) - seen
            seen |= fresh
            values = list(fresh)
        n += len(values)
        for at in range(0, len(values), 1 << 14):
            h = _lanes(np.array(values[at : at + (1 << 14)], np.uint64), lanes)
            votes += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > n, bitorder="little").view(np.uint64).tolist()


def fingerprints(docs: DataFrame, width: int = 3, lanes: int = 1, as_set: bool = False) -> DataFrame:
    """(doc_id, f0, f1, ...) of every row; a fingerprint word is a signed long. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py(), width, lanes, as_set) for t in b.column(1)]
            words = np.array(found, np.uint64).reshape(len(found), lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(words[:, i]) for i in range(lanes))],
                names=["doc_id", *(f"f{i}" for i in range(lanes))],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"f{i} long" for i in range(lanes)))


def pivots(blocks: int = BLOCKS, per_block: int = PER_BLOCK, seed: int = 7) -> list[list[int]]:
    """Reference fingerprints of each block: half the block's bits set, drawn from a fixed seed."""
    rng, size = random.Random(seed), BITS // blocks
    return [[sum(1 << (b * size + i) for i in rng.sample(range(size), size // 2)) for _ in range(per_block)] for b in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(prints: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds p0.. (packed distances to the pivots of a block) and k0.. (those less the distance to zero, packed)."""
    zero = F.bit_count("f0").cast("long")
    out = prints
    for b, references in enumerate(pivots(blocks)):
        dist = [F.bit_count(F.col("f0").bitwiseXOR(F.lit(_signed(r)))).cast("long") for r in references]
        p, k = F.lit(0).cast("long"), F.lit(0).cast("long")
        for d in dist:
            p = p * 256 + d
            k = k * 256 + (d - zero + BITS)
        out = out.withColumn(f"p{b}", p).withColumn(f"k{b}", k)
    return out


def within(a: Column, b: Column, radius: int) -> Column:
    """True if none of the seven packed coordinates differs by more than `radius`, for all seven at once."""
    shifted = a.bitwiseOR(F.lit(_HIGH)) - b + F.lit(radius * _ONES)
    small = (shifted.bitwiseAND(F.lit(_LOW)) + F.lit(_ABOVE(radius))).bitwiseAND(F.lit(_HIGH)) == 0
    return (shifted.bitwiseAND(F.lit(_HIGH)) == F.lit(_HIGH)) & small


def links(prints: DataFrame, radius: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Every pair (a, b), a < b, of distinct fingerprints f0 with at most `radius` differing bits."""
    keep = blocks - radius
    if keep < 1:
        raise ValueError("more blocks than the radius are needed")
    tables = [
        F.struct(F.xxhash64(F.lit(t), *(F.col(f"k{b}") for b in chosen)).alias("key"))
        for t, chosen in enumerate(itertools.combinations(range(blocks), keep))
    ]
    keyed = pivot_table(prints.select("f0"), blocks).withColumn("row", F.explode(F.array(*tables)))
    keyed = keyed.select(F.col("row.key").alias("key"), "f0", *(f"p{b}" for b in range(blocks)))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.col("a.f0") < F.col("b.f0")
    for i in range(blocks):
        near &= within(F.col(f"a.p{i}"), F.col(f"b.p{i}"), radius)
    verified = F.bit_count(F.col("a.f0").bitwiseXOR(F.col("b.f0"))) <= radius
    return a.join(b, (F.col("a.key") == F.col("b.key")) & near & verified).select(
        F.col("a.f0").alias("a"), F.col("b.f0").alias("b")
    )


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, f0, component_id) of every row; component_id is the smallest doc_id reachable over links.

    A null doc_id has a fingerprint and a component like any row, but never names one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, width))
    classes = scratch.save(prints.groupBy("f0").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes, radius)).withColumnRenamed("node", "f0")
    rooted = classes.join(roots, "f0", "left").withColumn("root", F.coalesce("root", "f0"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("f0", "root").join(named, "root").select("f0", "component_id")
    return prints.join(named, "f0").select("doc_id", "f0", "component_id")


#: Near-duplicate groups by similarity: words of a shingle, lanes of 64 bits, subsets of a document's shingles that give join keys, least mean size of a subset.
SIMILAR_WIDTH, LANES, SUBSETS, MEMBERS = 5, 4, 16, 2
#: The level below which no text goes, 2^4 subsets in all.
LEAST_LEVEL = 4
#: Bits of all lanes in which fingerprints of candidates differ at most. At similarity 0.8 a bit differs with probability 0.15 (the angle over pi), at worst 0.19 (five
#: shingles and four, whose votes tie): 39 or 48 of 256 bits, with deviations of 6, so the bound is 5 deviations or more away at any size. Unrelated texts differ in 128.
APART = 80
#: Longs of a set's parity: of each bit, whether an odd number of members fall on it. Above some 2,000 members it tells similar and other sets apart no more.
PARITY = 16
#: Salts over which the pairs of one class are dealt when its shingle set meets them.
SALTS = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    return _lanes(h, 2)[:, 1]


def sketch(text: str | None, width: int = SIMILAR_WIDTH, similarity: float = 0.8) -> tuple[list[int], int, int, list[tuple[int, list[int]]]]:
    """Of the set of a text's shingles: fingerprint words, size, hash of the whole set, and for each level its subsets' hashes (0: none).

    At level k a shingle belongs to subset `hash modulo 2^k`; the first SUBSETS are hashed. The level gives subsets of about MEMBERS
    to twice as many shingles, fewer in short texts, so a similar text has some of them unchanged. Where a text of the
    least size that is still similar has the level below, that one is given too.
    """
    parts = [np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in part), np.uint64) for part in shingles(text, width)]
    return sketch_of(np.concatenate(parts) if parts else np.zeros(0, np.uint64), similarity)


def sketch_of(hashes: np.ndarray, similarity: float = 0.8) -> tuple[list[int], int, int, list[tuple[int, list[int]]]]:
    """The sketch of a text with these shingle hashes, repeats included."""
    h = np.unique(hashes)
    n = len(h)
    votes = np.zeros(BITS * LANES, np.int64)
    for at in range(0, n, 1 << 14):
        votes += np.unpackbits(_lanes(h[at : at + (1 << 14)], LANES).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    words = np.packbits(2 * votes > n, bitorder="little").view(np.uint64).view(np.int64).tolist()
    mixed = _mixed(h)
    with np.errstate(over="ignore"):
        whole = int(mixed.sum(dtype=np.uint64).view(np.int64))
        levels = []
        level = lambda size: max(LEAST_LEVEL, int(math.log2(max(1, size) / MEMBERS)))
        for k in sorted({level(n), level(n * similarity)}) if n else []:
            subset = h & np.uint64((1 << k) - 1)
            sums = np.zeros(SUBSETS, np.uint64)
            own = subset < SUBSETS
            np.add.at(sums, subset[own].astype(np.int64), mixed[own])
            levels.append((k, sums.view(np.int64).tolist()))
    return words, n, whole, levels


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart; null as a value of its own."""
    return F.xxhash64(text.isNull(), text)


def sketches(docs: DataFrame, width: int = SIMILAR_WIDTH, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key, f0.., n, whole and levels of every row."""
    lanes = [f"f{i}" for i in range(LANES)]
    kind = pa.list_(pa.struct([("level", pa.int32()), ("subsets", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(t.as_py(), width, similarity) for t in b.column(2)]
            words = np.array([x[0] for x in found], np.int64).reshape(len(found), LANES)
            levels = [[{"level": k, "subsets": v} for k, v in x[3]] for x in found]
            columns = [*b.columns[:2], *(pa.array(words[:, i]) for i in range(LANES)), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array(levels, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", *lanes, "n", "whole", "levels"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, text_key long, {', '.join(f'{f} long' for f in lanes)}, n long, whole long, levels array<struct<level:int,subsets:array<bigint>>>"
    return rows.mapInArrow(lean(run), schema)


def _bits_apart(a: list[Column], b: list[Column]) -> Column:
    apart = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(apart[1:], apart[0])


#: Bits of a fingerprint's distance to a pivot that make one step of its coordinate, so that 0 to 256 bits are 0 to 64 steps, as `within` takes them.
STEP = BITS * LANES // 64


def with_pivots(classes: DataFrame) -> DataFrame:
    """Adds `pivot`: the distances of f0.. to seven reference fingerprints, packed, in steps of `STEP` bits.

    At this radius references that are near nothing discard nothing: distances to one differ by some 11 bits. So they are the fingerprints of the classes of most rows
    (the smallest ids of equal ones): around those lie the large groups of near copies, whose members are told at once from all texts outside that share a key with them.
    """
    lanes = [f"f{i}" for i in range(LANES)]
    drawn = [list(r) for r in classes.orderBy(F.col("rows").desc(), "id").limit(PER_BLOCK).select(*lanes).collect()]
    packed = F.lit(0).cast("long")
    for words in drawn:
        packed = packed * 256 + F.floor(_bits_apart([F.col(x) for x in lanes], [F.lit(w) for w in words]) / STEP)
    return classes.withColumn("pivot", packed)


def shared_keys(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each join key of a class that another class has too: key, id, f0.., n, pivot.

    Most keys are one class's alone, so all keys are dealt once and as numbers alone; only classes that share one bring their fingerprints, of which the pivot distances are worked out here, once.
    """
    each = classes.select("id", F.explode("levels").alias("l")).select("id", "l.level", F.posexplode("l.subsets").alias("subset", "hash"))
    key = Window.partitionBy("key")
    keyed = each.where("hash <> 0").select(F.xxhash64("level", "subset", "hash").alias("key"), "id")
    several = scratch.save(keyed.select("key", "id", (F.min("id").over(key) < F.max("id").over(key)).alias("several")).where("several").select("key", "id"))
    lanes = [f"f{i}" for i in range(LANES)]
    return scratch.save(several.join(with_pivots(classes).select("id", *lanes, "n", "pivot"), "id"))


def _near(similarity: float) -> Column:
    """Whether a and b have sizes and fingerprints that such a similarity allows. Pairs whose largest difference of pivot distances exceeds the radius go first; survivors are verified by their true distance."""
    lanes = [f"f{i}" for i in range(LANES)]
    apart = _bits_apart([F.col(f"a.{x}") for x in lanes], [F.col(f"b.{x}") for x in lanes])
    sizes = (F.col("a.n") >= F.col("b.n") * similarity) & (F.col("b.n") >= F.col("a.n") * similarity)
    return sizes & within(F.col("a.pivot"), F.col("b.pivot"), APART // STEP) & (apart <= APART)


def star_pairs(keyed: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of each class and the first and last one that share a key with it: two rows for each key at most."""
    me = F.struct("id", "n", "pivot", *(f"f{i}" for i in range(LANES)))
    ends = keyed.groupBy("key").agg(F.min(me).alias("m"), F.max(me).alias("x")).select("key", F.explode(F.array("m", "x")).alias("m")).select("key", "m.*")
    a, b = ends.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & _near(similarity)).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def rest_links(shared: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, width: int, scratch: Scratch) -> DataFrame:
    """All further links (a, b) between different components: of classes that share a key, members of its largest component need no test with each other.

    Only keys whose classes are in several components count, and the similarity is part of the join's condition. So a key that thousands of
    linked texts share costs a row for each link of those that aren't linked yet, not for each pair. Parities spare most of the comparisons of whole sets.
    """
    keyed = shared.join(classes.select("id", "comp", "size"), "id")
    large = keyed.groupBy("key").agg(F.max(F.struct("size", "comp"))["comp"].alias("large"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    marked = scratch.save(keyed.join(large.select("key", "large"), "key"))
    sets = sets_of(marked.select("id").distinct(), classes, docs, width, scratch)
    full = marked.join(sets, "id")
    a, b = full.where("comp <> large").alias("a"), full.alias("b")
    once = (F.col("b.comp") == F.col("b.large")) | (F.col("a.id") < F.col("b.id"))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & once & _near(similarity) & may_be_alike("a", "b", similarity) & alike(F.col("a.members"), F.col("b.members"), similarity)
    return scratch.save(a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, members, p0..) of rows: the sorted shingle hashes, 32 bits of each, and their parity."""
    parity = [f"p{i}" for i in range(PARITY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, odd = [], np.zeros((b.num_rows, PARITY), np.int64)
            for row, t in enumerate(b.column(2)):
                parts = [np.fromiter((xxhash.xxh64_intdigest(x, 42) & 0xFFFFFFFF for x in part), np.uint32) for part in shingles(t.as_py(), width)]
                members = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)
                found.append(members.view(np.int32))
                odd[row] = np.packbits((np.bincount(members % (64 * PARITY), minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)
            columns = [*b.columns[:2], pa.array(found, pa.list_(pa.int32())), *(pa.array(odd[:, i]) for i in range(PARITY))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "members", *parity])

    return docs.mapInArrow(lean(run), f"doc_id long, text_key long, members array<int>, {', '.join(f'{p} long' for p in parity)}")


def may_be_alike(a: str, b: str, similarity: float) -> Column:
    """False only for sets below that Jaccard similarity: each bit in which their parities differ takes a member that only one of them has."""
    differ = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(1, PARITY)), F.bit_count(F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0"))))
    return differ <= (F.size(F.col(f"{a}.members")) + F.size(F.col(f"{b}.members"))) * ((1 - similarity) / (1 + similarity)) + 1e-6


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two sets have that Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    return both >= similarity * (F.size(a) + F.size(b) - both) - 1e-9


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(id, members, p0..) of the classes in `ids`. Texts of these only are read again."""
    wanted = scratch.save(ids.join(classes, "id").select("id", F.col("least.doc_id").alias("want_id"), F.col("least.text_key").alias("want_key")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    named = listed(wanted)
    same = F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_key") == F.col("want_key"))
    sets = shingle_sets(rows.join(named, same, "left_semi"), width)
    return scratch.save(sets.join(named, same).select("id", "members", *(f"p{i}" for i in range(PARITY))).dropDuplicates(["id"]))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, width: int, scratch: Scratch) -> DataFrame:
    """The pairs whose shingle sets have that Jaccard similarity."""
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    salted = scratch.save(pairs.select("a", "b", salt("b").alias("salt_a"), salt("a").alias("salt_b")))
    ids = salted.select(F.col("a").alias("id")).unionByName(salted.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(ids, classes, docs, width, scratch)
    # a class of very many pairs brings its set once for each salt in use, so no task has all of its pairs
    side = lambda c: salted.select(c, f"salt_{c}").distinct().join(sets.select(F.col("id").alias(c), F.col("members").alias(f"set_{c}")), c)
    met = salted.join(side("b"), ["b", "salt_b"]).join(side("a"), ["a", "salt_a"])
    return scratch.save(met.where(alike(F.col("set_a"), F.col("set_b"), similarity)).select("a", "b"))


def superseded(docs: DataFrame, width: int = SIMILAR_WIDTH, similarity: float = 0.8) -> tuple[DataFrame, bool]:
    """(doc_id, text_key) of the rows that a near-duplicate with a smaller (doc_id, text_key) replaces, and whether rows repeat entirely.

    Texts of equal shingle sets are one class. Candidate classes share a subset's hash and have near fingerprints; a link is a candidate
    pair of at least that Jaccard similarity, and groups are the components of links. Near is decided by pivot distances, then by all bits. 64 bits at radius 2 would
    miss most pairs of similarity 0.8, which differ in about ten of 64 bits; hence the wider fingerprint.
    Null doc_ids come last.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = scratch.save(sketches(docs, width, similarity))
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    id_ = F.xxhash64("n", "whole")
    classes = scratch.save(rows.groupBy("n", "whole").agg(F.min(who).alias("least"), *(F.min(f"f{i}").alias(f"f{i}") for i in range(LANES)), F.first("levels").alias("levels"), F.count(F.lit(1)).alias("rows")).withColumn("id", id_).drop("whole"))
    shared = shared_keys(classes, scratch)
    star = scratch.save(star_pairs(shared, similarity))
    links_ = verified(star, classes, docs, similarity, width, scratch)

    def grouped(nodes: DataFrame) -> DataFrame:
        """(id, least, comp, size): classes with component and its size; a class without a link is its own."""
        sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        known = nodes.join(sizes, "root").select(F.col("node").alias("id"), F.col("root").alias("comp"), "size")
        return classes.select("id", "least").join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id")).withColumn("size", F.coalesce("size", F.lit(1)))

    linked = components(links_)
    more = rest_links(shared, scratch.save(grouped(linked)), docs, similarity, width, scratch)
    # components of components: a node's edge to its root stands for its links, so few rounds are left
    joined = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    final = scratch.save(grouped(joined).select("id", "comp", "least"))
    first = final.groupBy("comp").agg(F.min("least").alias("kept"))
    kept = final.join(first, "comp").select("id", "kept")
    gone = rows.withColumn("id", id_).join(kept, "id").where(~who.eqNullSafe(F.col("kept"))).select("doc_id", "text_key").distinct()
    repeats = rows.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0
    return scratch.save(gone), repeats
