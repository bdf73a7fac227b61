"""Near-duplicates of texts: SimHash over word n-grams, banded Hamming joins, features, clusters and representatives."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import graph

BITS = 64
#: Blocks of a join key of near hashes at most: 495 keys of 21 bits for a radius of 8.
MOST_BLOCKS = 4
#: Words without weight.
STOP = tuple("the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should".split())
#: Patterns that make a term important, and their factor.
PATTERNS = {
    "legal_terms": (r"(?i)\b(rechtsschutz|versicherung|klausel|bedingung|haftung)\b", 2.0),
    "insurance_benefits": (r"(?i)\b(leistung|erstattung|zahlung|deckung|schutz)\b", 1.8),
    "medical_terms": (r"(?i)\b(arzt|behandlung|krankenhaus|medizin|therapie)\b", 1.6),
    "exclusions": (r"(?i)\b(ausschluss|nicht|kein|ohne|ausgenommen)\b", 1.6),
    "numbers": (r"\d+", 1.3),
    "currency": (r"[€$£¥]\s*\d+|\d+\s*[€$£¥]", 1.3),
    "percentages": (r"\d+\s*%", 1.3),
}
#: Weights of content types, and of a representative's pattern hits.
TYPE_WEIGHTS = {"legal_text": 1.5, "technical_spec": 1.3, "narrative": 1.0, "table": 0.8, "list": 0.7, "mixed": 1.0}
HIT_WEIGHTS = {"legal_terms": 10, "insurance_benefits": 8, "medical_terms": 5}


def runs(w: Column, n: int) -> Column:
    """Space-joined runs of n elements. Shifted slices are zipped: a lambda that sliced `w` would compute it for each element anew."""
    count = F.greatest(F.lit(0), F.size(w) - n + 1)
    shifted = [F.slice(w, i + 1, count).alias(f"w{i}") for i in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda x: F.concat_ws(" ", *(x[f"w{i}"] for i in range(n))))


def ngrams(text: Column, n: int = 3) -> Column:
    """Runs of n words of the lower-cased text, repeats included; fewer words: none."""
    return runs(T.words(F.lower(text)), n)


def weighted_terms(text: Column, n: int = 3) -> Column:
    """Set of n-grams without stop and short words, and of important single words; short texts: the words, or the first 20 characters."""
    # lambdas of one element bind `bare` and `w`, which would be computed anew for each of their uses
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def of_words(bare, w):
        important = F.filter(w, lambda x: (F.length(x) >= 6) | F.rlike(x, F.lit("|".join(p for p, _ in PATTERNS.values()))))
        short = F.when(F.size(w) > 0, w).otherwise(F.array(F.left(bare, F.lit(20))))
        return F.array_distinct(F.when(F.size(w) < n, short).otherwise(F.concat(runs(w, n), important)))

    kept = lambda bare: F.filter(T.words(bare), lambda x: ~x.isin(*STOP) & (F.length(x) >= 3))
    return bind(T.normalise(text), lambda bare: bind(kept(bare), lambda w: of_words(bare, w)))


def term_weight(term: Column) -> Column:
    """Product of the factors of the patterns in a term, and more for long words."""
    weight = F.lit(1.0)
    for pattern, factor in PATTERNS.values():
        weight = weight * F.when(F.rlike(term, F.lit(pattern)), factor).otherwise(1.0)
    # most terms have none of the patterns, which one look tells; lengths and number of words come without splitting the term
    weight = F.when(F.rlike(term, F.lit("|".join(f"(?:{p})" for p, _ in PATTERNS.values()))), weight).otherwise(1.0)
    n = F.regexp_count(term, F.lit(r"\S+"))
    mean = F.length(F.translate(term, " \t\n\x0b\f\r", "")) / n
    return weight * F.when((n > 0) & (mean > 6), 1.0 + mean * 0.05).otherwise(1.0)


def hash64(term: Column) -> tuple[Column, Column]:
    """High and low 32 bits of the term's MD5 prefix: a hash that other engines have too."""
    h = F.md5(term)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")


#: Counts of this many bits that one sum holds, in so many bits each: exact up to two million terms of a document.
PACKED, PACK_BITS = 3, 21


def _voted(strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, simhash) of rows (key, hash, w) sorted by key, null being a key: weights of each bit are added up in batches, and the last key's votes wait for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = last = votes = names = None

        def out(keys: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            v = np.round(sums, 9)
            bits = np.packbits(v > 0 if strict else v >= 0, axis=1, bitorder="little")
            return pa.RecordBatch.from_arrays([keys, pa.array(bits.view(np.int64).ravel())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            ids, kind, names = b.column(0), b.column(0).type, [b.schema.names[0], "simhash"]
            coded = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(coded[1:] != coded[:-1]) + 1])
            bits = np.unpackbits(np.ascontiguousarray(b.column(1).to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w = b.column(2).to_numpy()[:, None]
            sums, keys = np.add.reduceat(np.where(bits == 1, w, -w), starts, axis=0), ids.take(pa.array(starts))
            if votes is not None and keys[0].as_py() == last:
                sums[0] += votes
            elif votes is not None:
                yield out(pa.array([last], kind), votes[None, :])
            yield out(keys.slice(0, len(keys) - 1), sums[:-1])
            last, votes = keys[-1].as_py(), sums[-1]
        if votes is not None:
            yield out(pa.array([last], kind), votes[None, :])

    return run


def simhash(terms: DataFrame, key: str, weight: Column | None = None, strict: bool = False) -> DataFrame:
    """(key, simhash) of terms (key, term): each bit by the sign of its votes, 0 counting as set unless strict. Votes are summed map-side.

    Without weights the set bits are counted, three counts to a long; 64 separate sums would outgrow one compiled method. With weights a row of a term goes to its document once,
    as hash and weight: sums of parts of a document would be 64 numbers for each part, and terms that were joined come from all parts.
    """
    high, low = hash64(F.col("term"))
    once = F.array(F.struct(high.alias("high"), low.alias("low"), (weight if weight is not None else F.lit(1)).alias("w")))
    rows = terms.select(key, F.explode(once).alias("x")).select(key, "x.*")  # exploded, so that the hash is made once and not for each vote
    bit_of = lambda i: F.shiftright("low" if i < 32 else "high", i % 32).bitwiseAND(F.lit(1))
    if weight is not None:
        hashed = rows.select(key, F.shiftleft("high", 32).bitwiseOR(F.col("low")).alias("hash"), F.col("w").cast("double").alias("w"))
        return hashed.repartition(key).sortWithinPartitions(key).mapInArrow(_voted(strict), f"`{key}` {terms.schema[key].dataType.simpleString()}, simhash long")
    pack = lambda g: sum((F.shiftleft(bit_of(i), PACK_BITS * k) for k, i in enumerate(range(g, min(g + PACKED, BITS))) if k), bit_of(g))
    return _decided(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(pack(g)).alias(f"s{g}") for g in range(0, BITS, PACKED))), key, strict)


def _decided(counts: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, simhash) of (key, n, s0, s3, ..): n terms, and how many of them have each bit, `PACKED` counts to a long."""
    ones = lambda i: F.shiftright(f"s{i - i % PACKED}", PACK_BITS * (i % PACKED)).bitwiseAND(F.lit((1 << PACK_BITS) - 1))
    set_ = lambda i: (2 * ones(i) > F.col("n")) if strict else (2 * ones(i) >= F.col("n"))
    half = lambda at: sum((F.shiftleft(F.when(set_(at + i), 1).otherwise(0).cast("bigint"), i) for i in range(1, 32)), F.when(set_(at), 1).otherwise(0).cast("bigint"))
    return counts.select(key, F.shiftleft(half(32), 32).bitwiseOR(half(0)).alias("simhash"))


_STOP = frozenset(STOP)
#: The patterns for Python: normalised texts are in lower case, digits are those of ASCII. `_MAYBE` finds all that a pattern can find, and more.
_RULES = tuple((re.compile(p.removeprefix("(?i)").replace(r"\d", "[0-9]")), factor) for p, factor in PATTERNS.values())
_MAYBE = re.compile("[0-9]|" + "|".join(x for p, _ in PATTERNS.values() if (m := re.search(r"\(([a-z|]+)\)", p)) for x in m[1].split("|")))


def weight_of(term: str) -> tuple[bool, float]:
    """Whether one of the patterns is in a normalised term, and its weight as `term_weight`. For Java, numerals that are no decimal digits end a word, as other signs do."""
    found, weight = False, 1.0
    if _MAYBE.search(term):
        if not term.isascii():
            term = "".join("-" if x.isnumeric() and not (x.isalpha() or x.isdecimal()) else x for x in term)
        for pattern, factor in _RULES:
            if pattern.search(term):
                found, weight = True, weight * factor
    n = len(term.split(" ")) - term.count("  ") if term.strip(" ") == term else len(term.split())
    mean = (len(term) - term.count(" ")) / n if term and n else 0
    return found, weight * (1.0 + mean * 0.05) if mean > 6 else weight


def weighed(bare: str, seen: dict[str, tuple[int, bool, bool, float]], n: int = 3) -> dict[str, float]:
    """As `weighted_terms`, of a text that is normalised, with the terms' weights. `seen` keeps words: a pattern that a run of words holds has a digit or a keyword in one of them, so most runs need no look."""
    w = [x for x in bare.split(" ") if len(x) >= 3 and x not in _STOP]
    if len(w) < n:
        return {t: weight_of(t)[1] for t in w or [bare[:20]]}
    known = []
    for x in w:
        if (k := seen.get(x)) is None:
            found, weight = weight_of(x)
            k = seen[x] = (len(x), bool(_MAYBE.search(x)), len(x) >= 6 or found, weight)
        known.append(k)
    grams = list(map(" ".join, zip(*(w[i:] for i in range(n)), strict=False)))
    sizes, maybe = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    mean = sum(sizes[i : len(w) - n + 1 + i] for i in range(n)) / n
    weights = np.where(mean > 6, 1.0 + mean * 0.05, 1.0)
    for i in np.flatnonzero(np.logical_or.reduce([maybe[i : len(w) - n + 1 + i] for i in range(n)])):
        weights[i] = weight_of(grams[i])[1]
    return dict(zip(grams, weights.tolist(), strict=True)) | {x: k[3] for x, k in zip(w, known, strict=True) if k[2]}


#: Bytes of text whose terms a task holds at once, terms whose counts are added up at once, and terms whose votes are.
PART_BYTES, RANGE_TERMS, VOTES = 8 << 20, 1_000_000, 50_000
_DIGEST = np.dtype([("h", ">u8"), ("e", ">u2"), ("rest", "V6")])


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their bytes' places, so that equal leading bytes stand together and a shuffle's compression takes them."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).reshape(-1).view(kind)


def _digests(terms: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    d = np.frombuffer(b"".join([hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in terms]), _DIGEST)
    return d["h"].astype(np.uint64), d["e"].astype(np.uint16)


def _sorted(h: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of terms, where a new one begins in it, and each position's number among the different ones."""
    order = np.lexsort((e, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (e[order][1:] != e[order][:-1])][: len(h)]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, new, number


def idf_simhash(docs: DataFrame, key: str, text: Column, n: int = 3) -> DataFrame:
    """(key, simhash): `simhash` of `weighted_terms` of the rows, a term weighing log(rows / (rows that have it + 1)) * `term_weight`; a bit needs more votes for than against.

    Texts are shuffled once, into parts of some 8 MB. A part asks for the counts of its terms, each once: it sends sorted hashes by ranges, and a range's task answers with counts in the same order, so
    neither terms nor votes are shuffled. A term is known by 80 bits of its MD5, of which the first 64 vote: among two billion terms, two have the same ones with a chance of one in 600,000.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    size = docs.select(F.octet_length(text).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    rows, held = size["n"], size["b"] or 0
    cores = spark.sparkContext.defaultParallelism
    parts, deep = max(cores, held // PART_BYTES), max(cores, held // 6 // RANGE_TERMS).bit_length()
    bare = docs.select(F.col(key).alias("key"), T.normalise(text).alias("bare")).where("bare is not null")
    dealt_ = bare.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartition(parts, "part")

    def known(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        seen, h, e, w, many = {}, [], [], [], []
        for t in texts:
            terms = weighed(t.as_py(), seen, n)
            x, y = _digests(terms)
            h.append(x)
            e.append(y)
            w.append(np.fromiter(terms.values(), float, len(terms)))
            many.append(len(terms))
        return np.concatenate(h), np.concatenate(e), np.concatenate(w), np.array(many)

    def asked(t: pa.Table) -> pa.Table:
        h, e, _, _ = known(t.column("bare"))
        order, new, number = _sorted(h, e)
        h, e, count = h[order][new], e[order][new], np.bincount(number).astype(np.uint32)
        at = h >> np.uint64(64 - deep)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[starts[1:], len(h)]
        data = [_planes(np.diff(h[i:j], prepend=np.uint64(0))) + _planes(e[i:j]) + _planes(count[i:j]) for i, j in zip(starts, ends, strict=True)]
        part = t.column("part")[0].as_py()
        return pa.table({"range": pa.array(at[starts].astype(np.int32)), "part": pa.array([part] * len(data), pa.int32()), "n": pa.array((ends - starts).astype(np.int32)), "data": pa.array(data, pa.binary())})

    def counted(t: pa.Table) -> pa.Table:
        h, e, c = [], [], []
        for data, m in zip(t.column("data"), t.column("n").to_pylist(), strict=True):
            raw = data.as_py()
            h.append(np.cumsum(_from_planes(raw[: 8 * m], np.uint64, m), dtype=np.uint64))
            e.append(_from_planes(raw[8 * m : 10 * m], np.uint16, m))
            c.append(_from_planes(raw[10 * m :], np.uint32, m))
        number = _sorted(np.concatenate(h), np.concatenate(e))[2]
        df = np.bincount(number, np.concatenate(c)).astype(np.uint32)[number]
        cuts = np.cumsum([0, *map(len, h)])
        return pa.table({"range": t.column("range"), "part": t.column("part"), "n": t.column("n"), "df": pa.array([_planes(df[i:j]) for i, j in itertools.pairwise(cuts)], pa.binary())})

    def voted(t: pa.Table, answers: pa.Table) -> pa.Table:
        t, answers = t.sort_by("key"), answers.sort_by("range")
        df = np.concatenate([_from_planes(d.as_py(), np.uint32, m) for d, m in zip(answers.column("df"), answers.column("n").to_pylist(), strict=True)])
        h, e, w, many = known(t.column("bare"))
        w = np.log(rows / (df[_sorted(h, e)[2]] + 1.0)) * w
        coded = pc.dictionary_encode(t.column("key").combine_chunks(), null_encoding="encode").indices.to_numpy()
        new = np.flatnonzero(np.r_[True, coded[1:] != coded[:-1]])
        owner = np.repeat(np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(coded)])), many)
        votes = np.zeros((len(new), BITS))
        for at in range(0, len(h), VOTES):
            bits = np.unpackbits(h[at : at + VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            part, own = w[at : at + VOTES, None], owner[at : at + VOTES]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            votes[own[starts]] += np.add.reduceat(np.where(bits == 1, part, -part), starts, axis=0)
        bits = np.packbits(np.round(votes, 9) > 0, axis=1, bitorder="little")
        return pa.table({key: t.column("key").take(pa.array(new)), "simhash": pa.array(bits.view(np.int64).ravel())})

    requests = dealt_.groupBy("part").applyInArrow(asked, "range int, part int, n int, data binary")
    counts = requests.repartition(1 << deep, "range").groupBy("range").applyInArrow(counted, "range int, part int, n int, df binary")
    return dealt_.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(voted, f"`{key}` {kind}, simhash long")


#: Bytes of a text whose words are cut at once.
PIECE = 1 << 20


def _runs(text: bytes, n: int) -> Iterator[list[bytes]]:
    """The space-joined runs of n words of a text, a list for each piece of it. `bytes.split` parts at the same white space as the pattern \\s."""
    held: list[bytes] = []
    cut = b""
    for at in range(0, len(text), PIECE):
        piece = cut + text[at : at + PIECE]
        words, cut = piece.split(), b""
        if at + PIECE < len(text) and not piece[-1:].isspace():
            cut = words.pop()
        words = held + words
        yield list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
        held = words[max(0, len(words) - n + 1) :]


def ngram_simhash(docs: DataFrame, key: str, text: Column, n: int = 3) -> DataFrame:
    """As `simhash` of `ngrams`: (key, simhash) of the rows' runs of n lower-cased words; keys without one are left out, and rows of one key vote together.

    A row's runs are hashed and their bits counted where the row is, and only 23 numbers a row are added up: rows of single runs would cost a hundred times a run's hash.
    """
    names = ["n", *(f"s{g}" for g in range(0, BITS, PACKED))]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for row, t in enumerate(b.column(1).cast(pa.binary())):
                for grams in _runs(t.as_py() or b"", n):
                    if grams:
                        md5 = np.frombuffer(b"".join([hashlib.md5(g, usedforsecurity=False).digest() for g in grams]), np.uint8).reshape(-1, 16)
                        bits = np.unpackbits(md5[:, 7::-1], axis=1, bitorder="little").sum(0, dtype=np.int64)
                        at.append(row)
                        found.append([len(grams), *(np.pad(bits, (0, -BITS % PACKED)).reshape(-1, PACKED) << (PACK_BITS * np.arange(PACKED))).sum(1)])
            sums = np.array(found, np.int64).reshape(len(at), len(names))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(sums[:, i]) for i in range(len(names)))], names=[b.schema.names[0], *names])

    counts = docs.select(key, F.lower(text).alias("text")).where("text is not null").mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{x} long' for x in names)}")
    return _decided(counts.groupBy(key).agg(*(F.sum(x).alias(x) for x in names)), key)


def copies(hashes: DataFrame, key: str, *also: str) -> DataFrame:
    """(id, simhash, also.., n): one row for each different hash (and value of `also`) with the smallest id that has it and how many do."""
    return hashes.groupBy("simhash", *also).agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("n"))


def kept_blocks(rows: int, radius: int) -> int:
    """How many blocks a join key holds so that keys and the candidate pairs of evenly spread hashes are fewest in all."""
    cost = lambda m: math.comb(radius + m, m) * rows * (1 + rows / 2 ** (BITS * m / (radius + m) + 1))
    return min(range(1, MOST_BLOCKS + 1), key=cost)


#: Comparisons of two hashes (`_matches`) that take as long as writing, sorting and reading one row of a join key.
ROW_COST = 200


def linking_blocks(rows: int, radius: int) -> int:
    """As `kept_blocks`, where a row that is shuffled costs as much as many comparisons."""
    cost = lambda m: math.comb(radius + m, m) * (ROW_COST + rows / 2 ** (BITS * m / (radius + m) + 1))
    return min(range(1, MOST_BLOCKS + 1), key=cost)


def dealt(rows: DataFrame, count: int) -> DataFrame:
    """Small rows over all cores before they are multiplied by their keys, a million in a partition at most."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, count // 1_000_000), "id")


def _masks(radius: int, blocks: int) -> list[int]:
    edges = [BITS * i // (radius + blocks) for i in range(radius + blocks + 1)]
    return [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(radius + blocks)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def keyed(rows: DataFrame, radius: int, blocks: int, *also: str) -> DataFrame:
    """(id, simhash, also.., choice, skipped, part): a row for each join key of rows (id, simhash, also..).

    Hashes are cut into radius + blocks blocks, of which two near ones share `blocks` or more: each choice of so many is an equi-join key of about
    64 * blocks / (radius + blocks) bits. `skipped` are the blocks before the last chosen one that are not chosen.
    """
    masks = _masks(radius, blocks)
    choices = []
    for chosen in itertools.combinations(range(radius + blocks), blocks):
        skipped = sum(1 << i for i in range(chosen[-1]) if i not in chosen)
        part = F.col("simhash").bitwiseAND(F.lit(_signed(sum(masks[i] for i in chosen))))
        choices.append(F.struct(F.lit(sum(1 << i for i in chosen)).alias("choice"), F.lit(skipped).alias("skipped"), part.alias("part")))
    return rows.select("id", "simhash", *also, F.explode(F.array(*choices)).alias("x")).select("id", "simhash", *also, "x.*")


#: Rows whose keys are compared at once, and pairs that are given on at once.
AT_ONCE, PAIRS = 200_000, 100_000


def _together(h: np.ndarray, start: np.ndarray, end: np.ndarray, root: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions to compare, each with later ones of its key. With roots: of different roots only, and none within the root that most rows of a key have."""
    if root is None:
        order, active = None, np.arange(len(h))
    else:
        by = np.lexsort((root, start))
        first = np.flatnonzero(np.r_[True, (start[by][1:] != start[by][:-1]) | (root[by][1:] != root[by][:-1])])
        key, kind, count = start[by][first], root[by][first], np.diff(np.r_[first, len(h)])
        most = np.lexsort((kind, count, key))
        main = np.zeros(len(h), root.dtype)
        main[key[most]] = kind[most]  # the last one of a key stays, which has most rows
        own = root == main[start]
        order = np.lexsort((own, start))  # rows of other roots come first in a key
        active = np.flatnonzero(~own[order])
    for d in range(1, len(h)):
        active = active[active + d < end[active]]
        if not len(active):
            return
        yield (active, active + d) if order is None else (order[active], order[active + d])


def _ends(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of each row and the first and the last one of its key."""
    at = np.arange(len(start))
    yield start[at != start], at[at != start]
    at = at[at != end - 1]
    yield at, end[at] - 1


#: Rows of a key that all others of it are compared with first.
PIVOTS = 8


def _pivots(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of each row and of some rows of its key."""
    at = np.arange(len(start))
    for i in range(PIVOTS):
        pivot = start + (end - start) * i // PIVOTS
        other = pivot != at
        yield pivot[other], at[other]


def _top(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The root of each position in a forest, which is made flatter."""
    top = parent[x]
    while (parent[top] != top).any():
        top = parent[top]
    parent[x] = top
    return top


def _joined(start: np.ndarray, end: np.ndarray, h: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], held: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links enough to connect what links connect, fewer than there are rows: pairs inside a component are not looked at again, and only rows outside a key's largest component are compared with all others."""
    parent = np.arange(len(h))

    def link(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for chosen in (near, lambda x, y: _top(parent, x) != _top(parent, y), held):
            if chosen and len(x):
                some = chosen(x, y)
                x, y = x[some], y[some]
        while len(x):
            a, b = _top(parent, x), _top(parent, y)
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            once = order[np.r_[True, high[order][1:] != high[order][:-1]]] if len(order) else order
            parent[high[once]] = low[once]  # each root goes under a smaller one, so no circle comes about
            yield x[once], y[once]

    for x, y in _pivots(start, end):
        yield from link(x, y)
    for x, y in _together(h, start, end, _top(parent, np.arange(len(h)))):
        yield from link(x, y)


def _late(start: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of rows and of an earlier near row of their key; a row that has one is not looked at again."""
    active = np.arange(len(start))
    d = 0
    while len(active):
        d += 1
        active = active[active - d >= start[active]]
        found = near(active, active - d)
        yield active[found], active[found] - d
        active = active[~found]


def _taken(start: np.ndarray, leads: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of rows that do not lead and of the first leader of their key that is near."""
    order = np.lexsort((~leads, start))  # a key's leaders come first, in the order of ids
    many = np.add.reduceat(leads, np.unique(start), dtype=np.int64)[np.unique(start, return_inverse=True)[1]]
    active = np.flatnonzero(~leads[order])
    for i in range(int(many.max(initial=0))):
        active = active[many[active] > i]
        leader = order[start[active] + i]
        found = near(order[active], leader)
        yield order[active[found]], leader[found]
        active = active[~found]


def _matches(radius: int, blocks: int, kind: str, alike: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(x, y, distance) of near rows of one key, of rows (choice, skipped, id, simhash[, root]) sorted by key and id; a key's rows wait until its last one is there.

    `ends`: of each row and its key's first and last one. `joined`: enough to connect them, if `alike` is given of pairs whose features `f` it holds for. `late`: of a row and one earlier near row.
    `taken`: of a row and the first near one that has `leads`. Else of all pairs (`rooted`: as `_together` does), at the first key that they share, as blocks before its last one differ, but for the chosen.
    """
    masks = np.array(_masks(radius, blocks), np.uint64)
    of_choice = np.array([sum(int(m) for i, m in enumerate(masks) if c >> i & 1) for c in range(1 << len(masks))], np.uint64)

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("id").combine_chunks()
        h, choice, skipped = (rows.column(c).to_numpy() for c in ("simhash", "choice", "skipped"))
        h = h.view(np.uint64)
        part = h & of_choice[choice]
        starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (choice[1:] != choice[:-1])])
        sizes = np.diff(np.r_[starts, len(h)])
        start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        root = pc.dictionary_encode(rows.column("root").combine_chunks()).indices.to_numpy() if kind == "rooted" else None
        f = np.asarray(rows.column("f").combine_chunks().flatten()).reshape(len(h), -1) if alike else None

        near_ = lambda x, y: np.bitwise_count(h[x] ^ h[y]) <= radius
        held_ = (lambda x, y: alike(f[x], f[y], np.bitwise_count(h[x] ^ h[y]))) if alike else None
        if kind == "joined":
            met = _joined(start, end, h, near_, held_)
        elif kind == "late":
            met = _late(start, near_)
        elif kind == "taken":
            met = _taken(start, rows.column("leads").to_numpy(), near_)
        else:
            met = _ends(start, end) if kind == "ends" else _together(h, start, end, root)
        found, held = [], 0
        for x, y in met:
            apart = h[x] ^ h[y]
            near = np.bitwise_count(apart) <= radius
            if root is not None:
                near &= root[x] != root[y]
            x, y, apart = x[near], y[near], apart[near]
            if kind in ("all", "rooted") and len(x):
                same = sum(((apart & m) == 0).astype(np.int64) << i for i, m in enumerate(masks))
                first = (skipped[x] & same) == 0
                x, y, apart = x[first], y[first], apart[first]
            for at in range(0, len(x), PAIRS):
                found.append((x[at : at + PAIRS], y[at : at + PAIRS], np.bitwise_count(apart[at : at + PAIRS]).astype(np.int64)))
                held += len(found[-1][0])
                if held >= PAIRS:
                    yield given(ids, found)
                    found, held = [], 0
        if held:
            yield given(ids, found)

    def given(ids: pa.Array, found: list) -> pa.RecordBatch:
        x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(apart)], names=["x", "y", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < AT_ONCE:
                continue
            choice, h = b.column(b.schema.get_field_index("choice")).to_numpy(), b.column(b.schema.get_field_index("simhash")).to_numpy().view(np.uint64)
            mine = of_choice[choice[-1]]
            other = np.flatnonzero((choice != choice[-1]) | ((h & mine) != (h[-1] & mine)))
            if len(other):  # else the key began in an earlier batch: looked for again at the next one
                cut = int(other[-1]) + 1
                yield from compared(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held, rows = [b.slice(cut)], b.num_rows - cut
        if held:
            yield from compared(pa.Table.from_batches(held))

    return run


def _compared(rows: DataFrame, count: int, radius: int, blocks: int, kind: str, alike: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(x, y, distance) by `_matches` of rows (id, simhash[, root][, f][, leads]), `count` of them: keys are dealt over tasks of about a million rows, shuffled once, and compared in batches of numbers."""
    spark, also = rows.sparkSession, ("f",) if alike else {"rooted": ("root",), "taken": ("leads",)}.get(kind, ())
    parts = max(spark.sparkContext.defaultParallelism, count * math.comb(radius + blocks, blocks) // 1_000_000)
    k = keyed(dealt(rows.where("simhash is not null"), count), radius, blocks, *also).repartition(parts, "choice", "part")
    ordered = k.sortWithinPartitions("choice", "part", "id").select("choice", "skipped", "id", "simhash", *also)
    return ordered.mapInArrow(_matches(radius, blocks, kind, alike), "x {0}, y {0}, distance long".format(rows.schema["id"].dataType.simpleString()))


def near_pairs(hashes: DataFrame, key: str, radius: int = 8, blocks: int = 2, count: int | None = None) -> DataFrame:
    """(a, b, distance), a < b, of hashes (key, simhash), of which there are `count`, at most `radius` bits apart. Equal hashes are a pair like any other, so give different ones (`copies`).

    These are all pairs, which a dense group has in the square of its size: components, leaders and followers below do without them.
    """
    found = _compared(hashes.select(F.col(key).alias("id"), "simhash"), hashes.count() if count is None else count, radius, blocks, "all")
    return found.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "distance")


def near_components(rows: DataFrame, radius: int = 8, linked: Callable[[DataFrame], DataFrame] | None = None, alike: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, root) of the rows (id, simhash[, f]; ids differ) that have a link, root being the smallest id reachable. Links are near pairs.

    With `alike` they are those near pairs for whose features `f` (arrays of doubles without nulls) and distance it holds; it is asked in the tasks. A task gives no more links of a key than the key has
    rows, so a dense group gives links as many as its rows and keys, not as their square, and links are kept before they are joined, so that no plan takes them for a small table.

    With `linked` they are those near pairs (a, b, distance) that it keeps, which have to be given out for that: rows are compared with the first and the last row of each of their keys, and what is then
    still apart in full, but only where a key holds rows of several components, and there not within the largest one. Pairs that `linked` discards are as many as there are.
    """
    graph.checkpoint_folder(rows.sparkSession)
    rows = rows.select("id", "simhash", *(["f"] if alike else [])).checkpoint()
    count = rows.count()
    blocks = linking_blocks(count, radius)
    pair = lambda found: found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    if linked is None:
        return graph.components(pair(_compared(rows, count, radius, blocks, "joined", alike)).select("a", "b").distinct().checkpoint())
    pairs = pair(_compared(rows, count, radius, blocks, "ends")).distinct().checkpoint()
    roots = graph.components(linked(pairs).select("a", "b"))
    labelled = rows.join(roots, "id", "left").select("id", "simhash", F.coalesce("root", "id").alias("root")).checkpoint()
    rest = pair(_compared(labelled, count, radius, blocks, "rooted")).checkpoint()
    return graph.components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(linked(rest).select("a", "b")))


def near_classes(hashes: DataFrame, key: str, radius: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, pairs): hashes read back, their different values by `copies`, and the near pairs (a, b, distance) of classes by their smallest ids."""
    graph.checkpoint_folder(hashes.sparkSession)
    members = hashes.select(F.col(key).alias("id"), "simhash").checkpoint()
    classes = copies(members, "id").checkpoint()
    count = classes.count()
    return members, classes, near_pairs(classes, "id", radius, linking_blocks(count, radius), count)


def near_links(hashes: DataFrame, key: str, radius: int = 8) -> DataFrame:
    """(a, b, distance), a < b: near pairs of classes of equal hashes, each by its smallest id, and each further member b of a class a at distance 0."""
    members, classes, pairs = near_classes(hashes, key, radius)
    more = members.join(classes.where("n > 1").select("simhash", F.col("id").alias("a")), "simhash").where("a <> id")
    return pairs.unionByName(more.select("a", F.col("id").alias("b"), F.lit(0).cast("bigint").alias("distance")))


#: Rows of one component that one task leads at once.
TOGETHER = 50_000


def _lead(radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Greedy leaders of a few rows in the order of ids: the first row left leads and takes all near it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, hashes = rows["id"].to_numpy(), rows["simhash"].to_numpy().view(np.uint64)
        leader, left = ids.copy(), np.arange(len(ids))
        while len(left):
            near = np.bitwise_count(hashes[left] ^ hashes[left[0]]) <= radius
            leader[left[near]] = ids[left[0]]
            left = left[~near]
        return pd.DataFrame({"id": ids, "led": leader})

    return run


def leaders(rows: DataFrame, radius: int = 8, together: int = TOGETHER) -> DataFrame:
    """(id, leader) of rows (id, simhash; ids differ and are integers) with a near one: in the order of ids, a row that no earlier leader is near leads, others join the first leader near them.

    A decision depends on smaller ids of the same component only. So each component is led by ranges of ids of at most about `together` rows, one task a range; the leaders that a range
    gives are compared, key by key, with the component's later rows, and what they take is out. Most components have one range. A chain of near rows costs no round for each of its links. No join broadcasts, as in `graph.components`.
    """
    known = rows.join(near_components(rows, radius).hint("merge"), "id").select("id", "simhash", "root", F.lit(None).cast(rows.schema["id"].dataType).alias("leader")).checkpoint()
    kind = "id {0}, {1} {0}".format(rows.schema["id"].dataType.simpleString(), "{}")
    shares = [2.0**-i for i in range(30)]
    while left := known.where("leader is null").count():
        blocks = linking_blocks(left, radius)
        rest = known.where("leader is null").select("id", "simhash", "root")
        halvings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / together)).cast("int"))
        cuts = rest.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("id", shares, 100_000).alias("at")).select("root", F.get("at", F.least(halvings, F.lit(len(shares) - 1))).alias("cut"))
        ranged = rest.join(cuts.hint("merge"), "root").checkpoint()
        led = ranged.where("id <= cut").select("root", "id", "simhash").groupBy("root").applyInPandas(_lead(radius), kind.format("led")).checkpoint()
        if not ranged.where("id > cut").limit(1).count():  # every component is in one range, as most are
            known = known.join(led.hint("merge"), "id", "left").select("id", "simhash", "root", F.coalesce("leader", "led").alias("leader")).checkpoint()
            continue
        lead = F.lit(True).alias("leads")
        met = led.where("id = led").select("id", lead).join(ranged.select("id", "simhash").hint("merge"), "id").unionByName(ranged.where("id > cut").select("id", F.lit(False).alias("leads"), "simhash"))
        taken = _compared(met, left, radius, blocks, "taken").groupBy(F.col("x").alias("id")).agg(F.min("y").alias("taker"))
        known = known.join(led.hint("merge"), "id", "left").join(taken.hint("merge"), "id", "left").select("id", "simhash", "root", F.coalesce("leader", "led", "taker").alias("leader")).checkpoint()
    return known.select("id", "leader")


def leader_of(hashes: DataFrame, key: str, radius: int = 8) -> DataFrame:
    """(id, leader) of rows with a near one: greedy leaders in the order of ids. Copies follow their class, as what is near one is near all."""
    graph.checkpoint_folder(hashes.sparkSession)
    members = hashes.select(F.col(key).alias("id"), "simhash").checkpoint()
    classes = copies(members, "id").checkpoint()
    led = classes.join(leaders(classes, radius).hint("merge"), "id", "left").where("n > 1 or leader is not null")
    return members.join(led.select("simhash", F.coalesce("leader", "id").alias("leader")).hint("merge"), "simhash").select("id", "leader")


def followers(hashes: DataFrame, key: str, radius: int = 8) -> DataFrame:
    """(id) of rows that have a near one of smaller id: further members of a class of equal hashes, and classes near an earlier one. Null hashes have none."""
    graph.checkpoint_folder(hashes.sparkSession)
    members = hashes.where("simhash is not null").select(F.col(key).alias("id"), "simhash").checkpoint()
    classes = copies(members, "id").checkpoint()
    count = classes.count()
    late = _compared(classes, count, radius, linking_blocks(count, radius), "late").select(F.col("x").alias("id")).distinct()
    return members.join(classes.select("id").hint("merge"), "id", "left_anti").select("id").unionByName(late)


def features(text: Column) -> dict[str, Column]:
    """Semantic features of a text: counts and densities of patterns, diversity, sentences, complexity."""
    w = T.words(F.lower(text))
    n = F.size(w)
    count = lambda p: F.regexp_count(text, F.lit(p))
    words, n = n, F.when(n == 0, float("nan")).otherwise(n)  # a text without words has no densities, and is no error either
    diversity = F.size(F.array_distinct(w)) / n
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]")))
    legal, benefit = count(PATTERNS["legal_terms"][0]) / n, count(PATTERNS["insurance_benefits"][0]) / n
    return {
        "word_count": words.cast("double"), "char_count": F.length(text).cast("double"), "avg_word_length": F.aggregate(w, F.lit(0.0), lambda s, x: s + F.length(x)) / n,
        **{f"{k}_density": count(p) / n for k, (p, _) in PATTERNS.items()},
        "lexical_diversity": diversity, "sentence_count": sentences.cast("double"), "words_per_sentence": n / sentences,
        "semantic_complexity": diversity * 0.3 + legal * 0.4 + benefit * 0.3,
    }


def feature_similarity(a: np.ndarray, b: np.ndarray, telling: list[int]) -> np.ndarray:
    """0.6 of the cosine of rows of features and 0.4 of the nearness of the telling ones."""
    dot = lambda x, y: sum(x[:, i] * y[:, i] for i in range(x.shape[1]))
    size = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    cosine = np.where(size == 0, 0.0, dot(a, b) / np.where(size == 0, 1.0, size))
    near = sum(1.0 - np.abs(a[:, i] - b[:, i]) for i in telling) / len(telling)
    return np.maximum(0.0, cosine * 0.6 + near * 0.4)


#: Ids that are broadcast to pick rows by; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, ..) whose id is among the ids, of which there may be many."""
    ids = ids.select("id").distinct().checkpoint()
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def clusters(hashes: DataFrame, docs: DataFrame, key: str, least: float = 0.85, radius: int = 8) -> DataFrame:
    """(id, root): components of the near pairs whose 0.7 * (1 - distance / 64) + 0.3 * feature similarity reaches `least`.

    Rows of equal hash and features are one class, linked in itself; components are those of classes (`near_components`). Features are made of the rows alone that have a copy of their hash or a near one.
    """
    graph.checkpoint_folder(docs.sparkSession)
    made = features(F.col("text"))
    names = list(made)
    hashed = hashes.select(F.col(key).alias("id"), "simhash").checkpoint()
    same = copies(hashed, "id").checkpoint()
    near = same.join(near_components(same, radius).hint("merge"), "id", "left").where("n > 1 or root is not null").select("simhash")
    members = hashed.join(near.hint("merge"), "simhash", "left_semi").checkpoint()
    texts = picked(docs.select(F.col(key).alias("id"), "text"), members)
    f = texts.select("id", F.array(*(F.coalesce(v, F.lit(0.0)) for v in made.values())).alias("f"))
    members = members.join(f.hint("merge"), "id").checkpoint()
    classes = copies(members, "id", "f").checkpoint()
    telling = [names.index(x) for x in ("legal_terms_density", "insurance_benefits_density", "semantic_complexity")]

    def alike(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return np.round(0.7 * (1 - distance / BITS) + 0.3 * feature_similarity(a, b, telling), 9) >= least

    roots = near_components(classes, radius, alike=alike)
    rooted = classes.join(roots.hint("merge"), "id", "left").where("n > 1 or root is not null").select("simhash", "f", F.coalesce("root", "id").alias("root"))
    return members.join(rooted.hint("merge"), ["simhash", "f"]).select("id", "root")


def representative_score(text: Column, level: Column, kind: Column) -> Column:
    """How well a text stands for its cluster: length, level, content type, words and pattern hits."""
    type_weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv)), kind), F.lit(1.0))
    hits = sum((F.regexp_count(text, F.lit(PATTERNS[k][0])) * w for k, w in HIT_WEIGHTS.items()), F.lit(0))
    return 0.001 * F.length(text) + 10.0 * (7 - level) + 25.0 * type_weight + 0.1 * F.size(T.words(text)) + hits
