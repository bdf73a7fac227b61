"""Mixing of sources to target weights over fixed-length blocks, with DataFrame functions only.

The words of a source's documents, one after another, are packed into blocks of `block` words. A source gets
slots for as many blocks as its target asks; each slot falls into an output shard by a seeded hash, so the source counts
of a shard (`draws`) are a multinomial draw given the source totals. The slots of a source map to its blocks through pseudorandom
permutations of the block indexes (swap-or-not, one permutation for each pass over the source), and
slots are joined with blocks by index.

Sources go by code point, null last, and weigh 3, 1, 2, repeating. Targets share `share` times all sizes by weight and stop at `most`
times their source's size, the excess going to the others by weight. A null or wordless text has size 0 and is never taken.
Repeated rows are documents of their own. Documents of equal id and size tie; which of them comes first changes nothing that is returned of either, but for
carried columns. A long text fills many blocks and costs a row for each. An empty table gives an empty result; other columns are ignored. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.scratch import Scratch

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SHARDS, SEED, ROUNDS = 64, 64, 5, 24
#: A source's documents are laid out in so many parts at once, or more where parts would hold more rows than these; sources are ranked in runs of as many.
PARTS, PART_ROWS = 128, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """doc_id, source, its key k (never null), size and carried columns of each row; texts go no further."""
    return docs.select(
        *carry,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("k"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def before(rows: DataFrame, order: list, sums: dict, scratch: Scratch, most: int = PART_ROWS) -> DataFrame:
    """`rows` with the sums of columns over all rows that come earlier in an order without ties: within runs of about `most` rows, then over the runs."""
    runs = -(-rows.count() // most) or 1
    parted = scratch.save(rows.repartitionByRange(runs, *order).withColumn("__run", F.spark_partition_id()))
    earlier = lambda by, *at: W.partitionBy(*by).orderBy(*at).rowsBetween(W.unboundedPreceding, -1)
    whole = parted.groupBy("__run").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))  # a row for each run
    whole = whole.select("__run", *(F.coalesce(F.sum(f"__{n}").over(earlier((), "__run")), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = parted.withColumns({n: F.coalesce(F.sum(c).over(earlier(("__run",), *order)), F.lit(0)) for n, c in sums.items()})
    joined = inside.join(F.broadcast(whole), "__run")
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__run", *(f"__{n}" for n in sums))


def targets(rows: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """For each source: k, source_size, target, number of blocks and of slots.

    Sources by growing size for their weight: where the first comes whose bound is above its share
    of what the ones before it leave, this share's level holds for it and all after.
    """
    per = scratch.save(rows.groupBy("k").agg(F.sum("size").alias("source_size")))
    per = before(per, [F.col("k") == "", F.col("k")], {"order": F.lit(1)}, scratch)
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("order") % len(weights) + 1).cast("int")))
    per = per.withColumn("bound", F.col("source_size") * float(most)).withColumn("ratio", F.col("bound") / F.col("weight"))
    per = before(scratch.save(per), [F.col("ratio"), F.col("k")], {"gone": F.col("bound"), "passed": F.col("weight")}, scratch)
    whole = per.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    per = scratch.save(per.join(F.broadcast(whole), F.lit(True)).withColumn("level", (F.col("all_size") * share - F.col("gone")) / (F.col("all_weight") - F.col("passed"))))
    level = per.where("ratio > level").agg(F.min(F.struct("ratio", "k", "level"))["level"].alias("common"))  # one row
    per = per.join(F.broadcast(level), F.lit(True)).withColumn("target", F.least("bound", F.coalesce(F.col("weight") * F.col("common"), F.col("bound"))))
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0)
    return per.select("k", "source_size", "target", blocks.cast("long").alias("blocks"), F.least(quota.cast("long"), blocks * most).alias("quota"))


def layout(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds `at`, the place of a document's first word among its source's words, and n, which tells equal rows apart. `rows` is a saved table: it is counted."""
    parts = parts or max(PARTS, -(-rows.count() // PART_ROWS))
    parted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)).cast("int"))
    sums = parted.groupBy("k", "part").agg(F.sum("size").alias("words"))
    earlier = sums.select("k", "part", (F.sum("words").over(W.partitionBy("k").orderBy("part")) - F.col("words")).alias("before"))
    order = W.partitionBy("k", "part").orderBy("doc_id", "size")
    inside = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    laid = parted.withColumn("inside", inside).withColumn("n", F.row_number().over(order))
    return laid.join(earlier, ["k", "part"]).withColumn("at", F.col("before") + F.col("inside")).drop("before", "inside")


def round_keys(size, k, turn, seed: int = SEED, rounds: int = ROUNDS):
    """Array of the keys of `permuted`, one for each round, for a source's pass."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(F.lit(seed), k, turn, r), size))


def permuted(index, size, keys):
    """Image of `index` under a pseudorandom permutation of 0..size-1, for any size: swap-or-not, a round for each key."""

    def step(x, key):
        other = F.pmod(key - x, size)
        return F.when(F.xxhash64(key, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(keys, index, step)


def slots(per: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A row for each slot: k, slot number in its source, output shard and the block it takes.

    A source's slots are made in chunks of `step`, each inside one pass over the source's blocks, in many tasks.
    """
    step = 1024
    long = lambda x: F.lit(x).cast("long")
    turns = per.where("quota > 0").withColumn("turn", F.explode(F.sequence(long(0), F.floor((F.col("quota") - 1) / F.col("blocks")).cast("long"))))
    turns = turns.withColumn("count", F.least(F.col("blocks"), F.col("quota") - F.col("turn") * F.col("blocks"))).withColumn("keys", round_keys(F.col("blocks"), F.col("k"), F.col("turn"), seed))
    chunks = turns.withColumn("first", F.explode(F.sequence(long(0), F.col("count") - 1, long(step))))
    chunks = chunks.repartition(int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "turn", "first")
    made = chunks.withColumn("index", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + step, F.col("count")) - 1)))
    slot = F.col("turn") * F.col("blocks") + F.col("index")
    return made.select("k", slot.alias("slot"), F.pmod(F.xxhash64(F.lit(seed), "k", slot), F.lit(shards)).cast("int").alias("shard"), permuted(F.col("index"), F.col("blocks"), F.col("keys")).alias("block"))


def pieces(laid: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and block it reaches into, with the words there; one with null block for an empty document."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first.cast("long"), last.cast("long")))))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    return cut.withColumn("words", words)


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, **law) -> DataFrame:
    """The mixture: a row for each slot and document in its block: shard, slot, k, block, doc_id, words and their first word's place."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(sizes(docs))
    chosen = slots(targets(rows, scratch, block=block, **law), shards, seed)
    cut = pieces(layout(rows), block).where("block is not null")
    return chosen.hint("merge").join(cut.withColumn("from", F.greatest(F.col("at"), F.col("block") * block) - F.col("at")), ["k", "block"]).select("shard", "slot", "k", "block", "doc_id", "from", "words")


def draws(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, **law) -> DataFrame:
    """(shard, k, slots): how many slots of each source the draw gives to each output shard."""
    scratch = Scratch(docs.sparkSession, "mixing")
    return slots(targets(scratch.save(sizes(docs)), scratch, block=block, **law), shards, seed).groupBy("shard", "k").agg(F.count(F.lit(1)).alias("slots"))


def taken(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, carry: tuple = (), **law) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, carried columns, the words that the mixture takes, repeats counted, and the number of output shards that hold some of them.

    Slots are counted by block before they meet the documents, with their output shards as bits (64 shards at most here), so no block's repeats multiply rows. Both sides of that
    join grow with the corpus, though a plan made from the small table of sources expects otherwise: hence the hint.
    """
    if shards > 64:
        raise ValueError("more shards than bits")
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(sizes(docs, carry))
    per = scratch.save(targets(rows, scratch, block=block, **law).coalesce(1))
    bit = F.expr("shiftleft(1L, shard)")
    uses = slots(per, shards, seed).groupBy("k", "block").agg(F.count(F.lit(1)).alias("uses"), F.bit_or(bit).alias("into"))
    cut = pieces(layout(rows), block)
    found = cut.join(uses.hint("merge"), ["k", "block"], "left").groupBy("k", "part", "n", "doc_id", "source", "size", *carry)
    found = found.agg(F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).cast("long").alias("taken"), F.bit_count(F.coalesce(F.bit_or("into"), F.lit(0).cast("long"))).cast("long").alias("shards"))
    return found.join(per.select("k", "source_size", "target"), "k").select("doc_id", "source", "size", "source_size", "target", "taken", "shards", *carry)
