"""Corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of the documents table.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read back as the next one's docs.
Rows that go are listed by (doc_id, hash of the text), so a row with a null or repeated id is decided by itself.
An empty table passes all stages; columns that the stages do not name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontam, kdshard, langid, mixing, simhash
from spindrift.llm.scratch import ROOTS, Scratch, clear
from spindrift.session import table

#: Cosine with the nearest language below which a text with letters is rejected: noise lies near 0, even texts of one word above.
LEAST_SCORE = 0.05
SHARDS = 8


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text_key) is not in `gone`."""
    listed = simhash.listed(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")))
    same = (simhash.text_key(F.col("text").cast("string")) == F.col("__gone_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id"))
    return docs.join(listed, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts like no learned language."""
    known = langid.train(docs)
    return docs.withColumn("__found", langid.column(F.col("text").cast("string"), known)).where((F.col("__found.lang_pred") != langid.UND) & (F.col("__found.score") >= LEAST_SCORE)).drop("__found")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies (five words, similarity 0.8), the one of the smallest id."""
    gone, repeats = simhash.superseded(docs)
    kept = _without(docs, gone)
    if not repeats:
        return kept
    return kept.withColumn("__key", simhash.text_key(F.col("text").cast("string"))).dropDuplicates(["doc_id", "__key"]).drop("__key")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    named = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), simhash.text_key(F.col("text").cast("string")).alias("text_key")).alias("row"), "text")
    hits = decontam.overlaps(named, table(spark, sf_dir, "benchmark"), key="row")
    return _without(docs, Scratch(spark, "leaks").save(hits.select("row.*").distinct()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mixture takes its words: taken / size, so not at all, once or twice.

    What is over a whole number is rounded up for as large a share of the documents, chosen by a hash, so that sources keep their targets; rounding
    each to the nearest would lose every source that is taken by less than half.
    """
    took = mixing.taken(docs.withColumn("__took_key", simhash.text_key(F.col("text").cast("string"))), carry=("__took_key",))
    draw = F.pmod(F.xxhash64(F.lit(mixing.SEED), "__took_id", "__took_key"), F.lit(1 << 20)) / float(1 << 20)
    per = took.where("size > 0").groupBy(F.col("doc_id").alias("__took_id"), "__took_key").agg((F.sum("taken") / F.sum("size")).alias("share"))
    times = per.select("__took_id", "__took_key", (F.floor("share") + F.when(draw < F.col("share") - F.floor("share"), 1).otherwise(0)).cast("int").alias("__times")).where("__times > 0")
    same = (simhash.text_key(F.col("text").cast("string")) == F.col("__took_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__took_id"))
    joined = docs.join(simhash.listed(Scratch(spark, "mix").save(times)), same)
    return joined.withColumn("__took_id", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of each document with its size, text_crc32, shard and slot by a k-d tree over bytes."""
    return kdshard.place(docs, SHARDS)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: Language profiles and fingerprint groups have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. A stage's intermediate tables and input are deleted once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        since = len(ROOTS)
        made = stage(spark, docs, sf_dir)
        output = Scratch(spark, "pipeline")
        docs = output.save(made)
        ROOTS.remove(output.root)
        clear(spark, since)
        if before:
            before.drop(0)
        before = output
    ROOTS.append(before.root)
    return docs
