"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts and benchmark items become lower-cased tokens of letters and digits. Fixed masks pick some of the tokens that follow a
position and ignore the others, so a substituted token spoils only the masks that pick it. Hashes of the masks are
joined between items and texts; a hit fixes an alignment of text and item. There the item's tokens are compared
with the text's, one by one, and the best run (a match counts 1, a substitution -2) is what overlaps.

The masks are checked to hit every run of a score that `sure_from` computes, 7 for the default ones, so what reaches the threshold (13, or 0.8 of a shorter item) is
found. An item so short that its threshold is lower is found by a mask of that many tokens in a row, as a run of under 15 tokens reaches 0.8 of the
item only without a substitution inside.

An item without tokens and a null item are never found; a null or empty text overlaps nothing. Repeated items count each; repeated rows of a document
give one result. Of equally good alignments the first in the text counts. Long texts and items cost in proportion to their length and hits. An empty table on either side
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.scratch import Scratch, listed

#: Token positions that each mask picks; each begins and ends with one.
MASKS = ("110110101", "11101011", "1110111", "11111001")
#: A run of this many matches above substitutions, or this part of a shorter item, overlaps.
LEAST, PART, SUBSTITUTION = 13, 0.8, -2
#: Seeds of the benchmark that are broadcast at most, 24 bytes each; more are joined by a shuffle, after a bitmap of this many bits (8 MB, whatever the number of seeds).
BROADCAST_SEEDS, BITMAP = 1_000_000, 1 << 26
#: Shortest item in which a run with a substitution inside can reach PART of it.
_INSIDE = 15


@cache
def sure_from(masks: tuple) -> int:
    """Least score from which every run holds a hit of some mask: one above the best score that a sequence of matches and substitutions reaches without any."""
    span = max(map(len, masks))
    picked = [int(m, 2) for m in masks]  # the newest position is the lowest bit
    seen, todo, best = {0: 0}, [(0, 0)], 0
    while todo:
        past, score = todo.pop()
        if seen[past] > score:
            continue
        for same in (0, 1):
            now = (past << 1 | same) & (1 << span) - 1
            if same and any(now & p == p for p in picked):
                continue
            reached = score + 1 if same else max(0, score + SUBSTITUTION)
            if reached > 2 * LEAST:
                return reached + 1  # without end
            if reached > seen.get(now, -1):
                seen[now], best = reached, max(best, reached)
                todo.append((now, reached))
    return best + 1


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null: none."""
    return F.coalesce(F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+", -1), ""), F.array().cast("array<string>"))


def _picked(mask: str, toks: Column, at: Column) -> Column:
    """Hash of the tokens that the mask picks from position `at` (from 0) on; null where the window ends too soon."""
    chosen = [F.get(toks, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(toks), F.xxhash64(F.lit(mask), *chosen))


def threshold(n: Column, least: int = LEAST) -> Column:
    """Score that a run must reach in an item of n tokens."""
    return F.least(F.lit(least), F.ceil(n * PART).cast("int"))


def seeds(items: DataFrame, masks: tuple, least: int = LEAST) -> tuple[DataFrame, list[str]]:
    """(h, item, at) for every position of every item (item, toks), and the masks in use."""
    sure = sure_from(masks)
    if sure > min(least, -(-_INSIDE * 4 // 5)):
        raise ValueError("masks that miss runs which overlap")
    n = F.size("toks")
    needed = threshold(n, least)
    short = sorted(r[0] for r in items.where(n > 0).select(needed.alias("t")).where(F.col("t") < sure).distinct().collect())  # fewer than `sure`
    used = [*masks, *("1" * t for t in short)]
    rows = items.where(n > 0).withColumn("at", F.explode(F.sequence(F.lit(0), n - 1)))
    hashes = [F.when(needed >= sure if i < len(masks) else needed == len(m), _picked(m, F.col("toks"), F.col("at"))) for i, m in enumerate(used)]
    return rows.withColumn("h", F.explode(F.array(*hashes))).where("h is not null").select("h", "item", "at"), used


def _bit(h: Column) -> Column:
    return F.pmod(h, F.lit(BITMAP))


def bitmap(known: DataFrame) -> DataFrame:
    """(bucket, bits): which seeds there are, by BITMAP bits of their hash, in at most BITMAP / 32768 rows of 4 kB."""
    return known.groupBy(F.bitmap_bucket_number(_bit(F.col("h"))).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit(F.col("h")))).alias("bits"))


def _set(bits: Column, place: Column) -> Column:
    """Whether the bit at `place` is set."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def _best(doc: Column, item: Column) -> Column:
    """Best run of aligned tokens: score, number of matches."""
    state = lambda s, m, bs, bm: F.struct(s.alias("s"), m.alias("m"), bs.alias("bs"), bm.alias("bm"))
    zero = F.lit(0)

    def step(acc, same):
        s = F.when(same, acc["s"] + 1).otherwise(acc["s"] + SUBSTITUTION)
        m = acc["m"] + F.when(same, 1).otherwise(0)
        s2, m2 = F.greatest(s, zero), F.when(s > 0, m).otherwise(0)
        return state(s2, m2, F.greatest(acc["bs"], s2), F.when(s2 > acc["bs"], m2).otherwise(acc["bm"]))

    return F.aggregate(F.zip_with(doc, item, lambda a, b: F.coalesce(a == b, F.lit(False))), state(zero, zero, zero, zero), step, lambda a: F.struct(a["bs"].alias("score"), a["bm"].alias("matched")))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", masks: tuple = MASKS, least: int = LEAST, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(key, item_id, matched, item_tokens, start) for each document and item that overlap, with the best alignment's start token.

    One pass over the texts; what leaves it is a row for each hit, not for each position. The hash table of the seeds is broadcast only if they are
    counted to be at most `broadcast_seeds`. More seeds are met by a shuffle of (row, position, hash) of those positions that a bitmap of fixed size lets pass; texts
    come back for rows with hits only.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    items = scratch.save(benchmark.select("item_id", tokens(F.col("text")).alias("toks")).withColumn("item", F.monotonically_increasing_id()))
    found, used = seeds(items, masks, least)
    known = scratch.save(found)
    small = known.count() <= broadcast_seeds
    # a row is told by its key and the hash of its text; rows equal in both have the same overlaps
    named = docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("th"), F.col("text"))
    rows = named.select("key", "th", tokens(F.col("text")).alias("doc"))
    spots = rows.withColumn("pos", F.explode(F.when(F.size("doc") > 0, F.sequence(F.lit(0), F.size("doc") - 1))))
    names = [f"h{i}" for i in range(len(used))]
    if small:
        hashed = spots.select("key", "th", "pos", *(_picked(m, F.col("doc"), F.col("pos")).alias(h) for m, h in zip(used, names, strict=True)))
        distinct = known.select("h").distinct()
        for i, h in enumerate(names):
            side = F.broadcast(distinct.select(F.col("h").alias(h), F.lit(True).alias(f"y{i}")))  # at most broadcast_seeds rows
            hashed = hashed.join(side, h, "left")
        hashed = hashed.where(" or ".join(f"y{i}" for i in range(len(used))))
        likely = hashed.select("key", "th", "pos", F.explode(F.array(*names)).alias("h")).where("h is not null")
        met = likely.join(F.broadcast(known), "h")  # as many
    else:
        hashed = spots.select("key", "th", "pos", F.explode(F.array(*(_picked(m, F.col("doc"), F.col("pos")) for m in used))).alias("h")).where("h is not null")
        likely = hashed.join(F.broadcast(bitmap(known)), F.bitmap_bucket_number(_bit(F.col("h"))) == F.col("bucket")).where(_set(F.col("bits"), F.bitmap_bit_position(_bit(F.col("h")))))
        met = likely.select("key", "th", "pos", "h").join(known.hint("merge"), "h")
    # the document token under the item's first; an alignment that many seeds hit is one row
    hits = scratch.save(met.select(F.col("key").alias("hit"), F.col("th").alias("hit_th"), "item", (F.col("pos") - F.col("at")).alias("start")).distinct())
    hits, same = listed(hits), F.col("key").eqNullSafe(F.col("hit")) & (F.col("th") == F.col("hit_th"))
    texts = named.join(hits, same, "left_semi").select("key", "th", tokens(F.col("text")).alias("doc")).join(hits, same).select("key", "doc", "item", "start")
    sized = items.select("item", "item_id", "toks", F.size("toks").alias("n"))
    part = F.slice("doc", F.greatest(F.col("start"), F.lit(0)) + 1, F.greatest(F.col("n") + F.least(F.col("start"), F.lit(0)), F.lit(0))).alias("part")
    aligned = texts.join(F.broadcast(sized) if small else sized, "item").select("key", "item_id", "toks", "n", "start", part)  # its tokens are fewer than its seeds
    padded = F.concat(F.array_repeat(F.lit("").cast("string"), F.greatest(-F.col("start"), F.lit(0))), F.col("part"))
    best = aligned.withColumn("best", _best(padded, F.col("toks")))
    kept = best.where(F.col("best.score") >= threshold(F.col("n"), least))
    return kept.groupBy("key", "item_id").agg(F.max_by(F.struct(F.col("best.matched").cast("long").alias("matched"), F.col("n").cast("long").alias("item_tokens"), F.greatest(F.col("start"), F.lit(0)).cast("long").alias("start")), F.struct("best.score", -F.col("start"))).alias("x")).select(F.col("key").alias(key), "item_id", "x.*")
