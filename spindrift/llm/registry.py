"""The queries of this subpackage, with DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import audio, chat, decontam, filteraudit, htmltext, kdshard, langid, lattice, mixing, oracles, secrets, simhash, urlrep, whitening
from spindrift.llm.scratch import Scratch
from spindrift.session import spread, table

QUERIES: dict = {}
ORACLES: dict = dict(oracles.ORACLES)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash links at two bits over 3-word shingles of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    known = langid.train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.predict(docs, known, ["doc_id", "held_out"])


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


@query
def op5_kdshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    placed = kdshard.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes from each document."""
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


@query
def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, tolerant of substituted words."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as mu-law, A-law and ADPCM recordings in a table, read back, expanded and resampled."""
    return audio.digests(Scratch(spark, "audio").save(audio.store(table(spark, sf_dir, "documents"))))


@query
def op8_urlrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; the outcome of a page is the quality label of its number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urlrep.verdicts(table(spark, sf_dir, "pages"), outcomes)


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base spans, and live ones by ownership."""
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k[0]}") for i, k in enumerate(secrets.KINDS)), F.sha2(secrets.spell(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.spell(F.concat("base", "live")).alias("spans"))


@query
def op9_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on up to eight whitened components."""
    return whitening.by_component(table(spark, sf_dir, "embeddings"), components=8)


@query
def op12_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all orders, by language."""
    return filteraudit.documents(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query
def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents by words and by all segmentations into subwords."""
    return lattice.score(spread(table(spark, sf_dir, "documents")))
