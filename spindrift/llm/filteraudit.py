"""Filter interaction audit: what each filter of a set removes, for every order of the set.

Each row fails some filters; rows with the same failures are alike, so a part of the table comes down to at most 2^k counted cells. The k! orders are then
walked by adjacent transpositions: each differs from the one before by one swap of neighbours, which leaves what comes before and after the two steps
unchanged, so only those two are counted anew from the cells. Shapley values add up along the walk.

A null text is empty, a null part the empty string. Every part of the table gets all orders and steps, zeros included. Repeated rows count as often as
they occur. Of equal texts, all whose id is larger than the smallest fail `E`; a null id is neither smaller nor larger than another. A label of a row that
is repeated counts once if any says so. Texts of any length are read once and are not shuffled: copies meet by the text's SHA-256, rows of a text are counted by part before they meet.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = "ABCDE"
#: Filters by text: words at least, share of different words at least, share of capitals at most (percent), characters of markup.
WORDS, DIFFERENT, CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
#: More filters have too many orders to be listed.
MOST = 8
COUNTS = ("rows", "good", "toxic")


def transpositions(k: int) -> Iterator[int]:
    """Positions i of the swaps (i, i+1) that lead from the identity through all k! permutations, each once: the largest movable element moves on, and what is larger turns round."""
    order, way = list(range(k)), [-1] * k
    while True:
        movable = [x for i, x in enumerate(order) if 0 <= i + way[x] < k and order[i + way[x]] < x]
        if not movable:
            return
        x = max(movable)
        i = order.index(x)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        way[x + 1 :] = [-w for w in way[x + 1 :]]
        yield min(i, j)


def walk(cells: np.ndarray, k: int) -> Iterator[tuple[list[int], list[tuple[int, ...]]]]:
    """Every order of k filters with a tuple for each step: kept, removed, redundant, good lost, toxic lost.

    `cells` has a row for each set of failures, by its bits, and the columns rows, good, toxic.
    """
    sets = np.arange(1 << k)
    whole = int(cells[:, 0].sum())

    def step(f: int, earlier: int) -> tuple[int, ...]:
        fails, free = sets >> f & 1 == 1, sets & earlier == 0
        removed, good, toxic = (int(v) for v in cells[fails & free].sum(0))
        return int(cells[free & ~fails, 0].sum()), removed, int(cells[fails & ~free, 0].sum()), good, toxic

    order = list(range(k))
    steps = [step(f, (1 << f) - 1) for f in order]
    yield order, steps
    for i in transpositions(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        earlier = sum(1 << f for f in order[:i])
        steps[i], steps[i + 1] = step(order[i], earlier), step(order[i + 1], earlier | 1 << order[i])
        yield order, steps


def shapley(cells: np.ndarray, k: int) -> list[int]:
    """What each filter removes, summed over all orders. A step counts as often as the walk leaves it as it is."""
    total, since = [0] * k, [0] * k
    held: list[tuple[int, int]] = []
    at = 0
    for at, (order, steps) in enumerate(walk(cells, k)):
        now = [(f, s[1]) for f, s in zip(order, steps, strict=True)]
        for i, entry in enumerate(now):
            if not held or held[i] != entry:
                if held:
                    total[held[i][0]] += held[i][1] * (at - since[i])
                since[i] = at
        held = now
    for i, (f, removed) in enumerate(held):
        total[f] += removed * (at + 1 - since[i])
    return total


def cells_of(rows: DataFrame, part: str, mask: str, good: str, toxic: str, n: str | None = None) -> DataFrame:
    """(part, cells): for each part a list of (mask, rows, good, toxic), no longer than the sets of failures. `n`: rows that a row stands for."""
    size = F.col(n) if n else F.lit(1)
    per = rows.groupBy(F.col(part).alias("part"), F.col(mask).cast("int").alias("mask")).agg(*(F.sum(c).cast("long").alias(a) for c, a in zip((size, good, toxic), COUNTS, strict=True)))
    return per.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", *COUNTS))).alias("cells"))


def audit(cells: DataFrame, names: str = NAMES) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step of each part."""
    k = len(names)
    if not 1 <= k <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, listed in zip(b["part"], b["cells"], strict=True):
                table = np.zeros((1 << k, len(COUNTS)), np.int64)
                for c in listed:
                    table[c["mask"]] = [c[x] for x in COUNTS]
                shares, rows = shapley(table, k), []
                for order, steps in walk(table, k):
                    spelt = "".join(names[f] for f in order)
                    rows += [(part, spelt, i + 1, s[0], s[1], s[2], int(table[1 << f, 0]), s[3], s[4], shares[f]) for i, (f, s) in enumerate(zip(order, steps, strict=True))]
                yield pd.DataFrame(rows, columns=columns)

    return cells.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns[3:]))


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    tests = (n < WORDS, different * 100 < n * DIFFERENT, capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITALS, F.rlike(text, F.lit(MARKS)))
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counted rows of documents (doc_id, text, lang) that fail the same filters, with labels (doc_id, quality, toxic)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("key"), text_failures(text).alias("mask"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    same = rows.groupBy("key", "part", "mask", "id").agg(F.count(F.lit(1)).alias("n"))
    each = same.join(said, "id", "left").select("key", "part", "mask", "id", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")))
    ids = F.struct("id", "n", "good", "toxic")
    # of a text and a part: all rows, those of the smallest id, and those without id
    per = each.groupBy("key", "part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), F.min(F.when(F.col("id").isNotNull(), ids)).alias("first"), *(F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_0") for c in ("n", "good", "toxic")))
    least = per.groupBy("key").agg(F.min("first.id").alias("least"))
    met = per.join(least, "key")
    own = F.col("first.id") == F.col("least")
    stay = {c: F.col(f"{c}_0") + F.when(own, F.col(f"first.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    both = F.array(F.struct("mask", *(v.alias(c) for c, v in stay.items())), F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - v).alias(c) for c, v in stay.items())))
    return met.select("part", F.explode(both).alias("c")).select("part", "c.*").where("n > 0")


def documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E by language."""
    return audit(cells_of(failures(docs, labels), "part", "mask", "good", "toxic", "n"))
