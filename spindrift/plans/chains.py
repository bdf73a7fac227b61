"""Queries of files that become chunks, and of observed stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift import plugins
from spindrift.functions import text as T
from spindrift.operators.observed import Trace
from spindrift.plans import chunking as _known  # noqa: F401  its SQL is used again
from spindrift.plans.registry import ORACLES, query
from spindrift.session import documents
from spindrift.sources import chain


def files(spark, sf_dir):
    """Every document as a file: one in seven of bytes that are no text, one in eleven sealed, in the others each `. ` ends a page."""
    text = F.coalesce("text", F.lit(""))
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(b"\xff"), F.encode(text, "utf-8"))).when(F.col("doc_id") % 11 == 0, F.encode(F.concat(F.lit("SEALED "), text), "utf-8"))
    return documents(spark, sf_dir).select(F.concat(F.lit("file-"), F.col("doc_id").cast("string")).alias("path"), content.otherwise(F.encode(F.concat(F.lit("T "), F.replace(text, F.lit(". "), F.lit(".\f"))), "utf-8")).alias("content"))


def sealed(content: bytes) -> chain.Opened:
    """A reader of a format whose files are all locked."""
    if not content.startswith(b"SEALED"):
        raise ValueError("not sealed")
    return chain.Opened((), encrypted=True)


@query("file_chain", r"""WITH f AS (SELECT 'file-' || doc_id AS path, doc_id % 7 = 0 AS broken, doc_id % 7 <> 0 AND doc_id % 11 = 0 AS locked, 'T ' || replace(coalesce(text, ''), '. ', '.' || chr(12)) AS t FROM documents),
s AS (SELECT path, locked AS encrypted, NOT broken AND NOT locked AS has_text, CASE WHEN NOT broken AND NOT locked THEN len(string_split(t, chr(12))) END AS page_count, CASE WHEN broken THEN 'sealed: ValueError; html: UnicodeDecodeError; text: UnicodeDecodeError' WHEN locked THEN 'encrypted' WHEN length(regexp_replace(t, '[^A-Za-z0-9]+', '', 'g')) < 10 THEN 'no meaningful text' END AS error FROM f)
SELECT path, encrypted, has_text, page_count::INTEGER AS page_count, CASE WHEN has_text THEN 'text' END AS method, error, CASE WHEN error IS NULL THEN 'acme/text/' || page_count END AS stamp, CASE WHEN error IS NULL THEN 0 ELSE 1 END::BIGINT AS failures, error IS NULL AS chunked FROM s""")
def file_chain(spark, sf_dir):
    """What became of each file: its probe, the reader that opened it, the stamp that all its chunks carry, or its one failure."""
    read = chain.read(files(spark, sf_dir), [("sealed", sealed), *chain.READERS])
    probe = ("encrypted", "has_text", "page_count", "method")
    made = chain.chunks(read, "acme", also=probe)
    stamp = F.when(F.col("error").isNull(), F.concat_ws("/", F.col("meta.tenant"), F.col("meta.extraction_method"), F.col("meta.page_count")))
    per = made.groupBy("path", *probe, "error").agg(F.min(stamp).alias("stamp"), F.max(stamp).alias("last"), F.count("error").alias("failures"), F.count("chunk_id").alias("chunks"))
    return per.select("path", *probe, "error", F.when(F.col("stamp") == F.col("last"), F.col("stamp")).alias("stamp"), "failures", (F.col("chunks") > 0).alias("chunked"))


@query("observed_stages", r"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents), m AS (SELECT * FROM d WHERE length(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) >= 10), u AS (SELECT min(doc_id) AS doc_id FROM m GROUP BY lower(text))
SELECT 1 AS place, 'read' AS stage, count(*) AS rows, count(*) FILTER (WHERE lang IS NULL) AS nulls, sum(length(text))::DOUBLE AS measure FROM d UNION ALL SELECT 2, 'meaningful', count(*), 0, sum(length(text)) FROM m UNION ALL SELECT 3, 'distinct', count(*), 0, NULL FROM u""")
def observed_stages(spark, sf_dir):
    """Rows of three stages of ingestion, counted by the action that runs them."""
    trace = Trace(spark, "ingest")
    d = documents(spark, sf_dir).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    length = F.length("text")
    kept = trace.stage("meaningful", trace.stage("read", d, ("lang",), length).where(T.meaningful(F.col("text"))), measure=length)
    first = trace.stage("distinct", kept.groupBy(F.sha2(F.lower("text"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id")))
    with trace.run():
        first.write.format("noop").mode("overwrite").save()
    return trace.rows().select("place", "stage", "rows", F.coalesce(F.col("nulls")["lang"], F.lit(0).cast("long")).alias("nulls"), "measure")


@query("chunks_lateral", ORACLES["chunks_tokens"])
def chunks_lateral(spark, sf_dir):
    """Token-budget chunks by a lateral join with the table function."""
    plugins.register(spark)
    return spark.sql("SELECT doc_id, c.n, c.sentences AS n_sentences, c.tokens FROM {d} AS d, LATERAL chunk_text(d.text, 120, 1) AS c", d=documents(spark, sf_dir))
