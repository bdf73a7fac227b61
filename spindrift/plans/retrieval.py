"""Queries of retrieval: lexical, dense, fused, reranked and summarised hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import lexical
from spindrift.operators import retrieval as R
from spindrift.plans.registry import query
from spindrift.session import documents, table
from spindrift.sources.versions import shared_folder

FIXED = "The thanea of eriner and tionth the anly"
_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
#: BM25 over documents for queries q(qid, text), with all the zero scores.
BM25 = rf"""t AS (SELECT doc_id AS id, {_TOK.format('text')} AS toks FROM documents), size AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(toks) AS term FROM t) GROUP BY term),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, size), fl AS (SELECT 0.25 * avg(idf) AS f FROM idf),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_TOK.format('text')}) AS term FROM q) GROUP BY qid, term),
tf AS (SELECT id, len(toks) AS dl, term, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY id, toks, term),
sc AS (SELECT qid, id, sum(CASE WHEN idf < 0 THEN f ELSE idf END * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN idf USING (term) JOIN qt USING (term), size, fl GROUP BY qid, id),
bm AS (SELECT q.qid, t.id, coalesce(score, 0.0) AS score FROM q CROSS JOIN t LEFT JOIN sc ON sc.qid = q.qid AND sc.id = t.id)"""
RANKED = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)"
#: Queries are every item, or vector, whose id is divisible by 20, against all documents or vectors.
ASKED = "q AS (SELECT item_id AS qid, text FROM benchmark WHERE item_id % 20 = 0)"
DENSE = "dn AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"
TOPS = f"b12 AS (SELECT qid, id, score, {RANKED} AS rank FROM bm QUALIFY rank <= 12), d8 AS (SELECT qid, id, score, {RANKED} AS rank FROM dn QUALIFY rank <= 8)"


def chunks(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


def asked(spark, sf_dir, which="item_id % 20 = 0"):
    return table(spark, sf_dir, "benchmark").where(which).select(F.col("item_id").alias("qid"), "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked_vectors(spark, sf_dir, which="id % 20 = 0"):
    return vectors(spark, sf_dir).where(which).select(F.col("id").alias("qid"), "vec")


@query("bm25_topk", f"WITH q AS (SELECT 1::BIGINT AS qid, '{FIXED}' AS text), {BM25} SELECT id AS doc_id, round(score, 6) AS score, {RANKED} AS rank FROM bm QUALIFY rank <= 10")
def bm25_topk(spark, sf_dir):
    """Ten best documents for one fixed query."""
    q = spark.range(1, 2).select(F.col("id").alias("qid"), F.lit(FIXED).alias("text"))
    return R.bm25(chunks(spark, sf_dir), q, 10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("bm25_stored", f"WITH {ASKED}, {BM25} SELECT qid, id, round(score, 6) AS score, {RANKED} AS rank FROM bm QUALIFY rank <= 10")
def bm25_stored(spark, sf_dir):
    """Ten best documents of each query from an index in a folder, to which the second half of the documents came as a segment of its own."""
    stored = lexical.Stored(spark, shared_folder(spark, "bm25"))
    c = chunks(spark, sf_dir)
    for half in (0, 1):
        stored.add(c.where(F.col("id") % 2 == half), f"half {half}")
    return stored.search(asked(spark, sf_dir), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("knn_topk", f"WITH {DENSE} SELECT qid, id, round(score, 6) AS score, {RANKED} AS rank FROM dn QUALIFY rank <= 10")
def knn_topk(spark, sf_dir):
    """Ten nearest vectors of each query."""
    return R.dense(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("knn_filtered", f"WITH {DENSE} SELECT qid, id, round(score, 6) AS score, {RANKED} AS rank FROM dn JOIN embeddings e ON e.vec_id = id WHERE e.label IN (1, 2) QUALIFY rank <= 5")
def knn_filtered(spark, sf_dir):
    """Five nearest vectors that pass a metadata filter, which comes before the choice."""
    from spindrift.functions.filters import metadata_match

    return R.dense(vectors(spark, sf_dir).where(metadata_match({"label__in": [1, 2]})), asked_vectors(spark, sf_dir), 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("dense_retrieve", f"WITH {DENSE} SELECT qid, id, round(score, 6) AS score, d.source FROM (SELECT *, {RANKED} AS rank FROM dn QUALIFY rank <= 8) JOIN documents d ON d.doc_id = id WHERE d.lang = 'en'")
def dense_retrieve(spark, sf_dir):
    """Dense hits with their documents, filtered again."""
    hits = R.dense(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 8)
    return hits.join(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source"), "id").select("qid", "id", F.round("score", 6).alias("score"), "source")


def lists(spark, sf_dir):
    return R.dense(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 8), R.bm25(chunks(spark, sf_dir), asked(spark, sf_dir), 12)


RRF = "rf AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score, min((list, rank)) AS first FROM (SELECT qid, id, rank, 0 AS list FROM d8 UNION ALL SELECT qid, id, rank, 1 FROM b12) GROUP BY qid, id)"


@query("rrf_hybrid", f"WITH {ASKED}, {BM25}, {DENSE}, {TOPS}, {RRF} SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first) AS rank FROM rf QUALIFY rank <= 5")
def rrf_hybrid(spark, sf_dir):
    """Five best of dense and lexical hits by reciprocal ranks."""
    return R.rrf(list(lists(spark, sf_dir))).where("rank <= 5").select("qid", "id", F.round("score", 6).alias("score"), "rank")


_MM = "SELECT qid, id, (score - min(score) OVER (PARTITION BY qid)) / CASE WHEN max(score) OVER (PARTITION BY qid) = min(score) OVER (PARTITION BY qid) THEN 1e-8 ELSE max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid) END AS s FROM"


@query("weighted_hybrid", f"WITH {ASKED}, {BM25}, {DENSE}, {TOPS}, a AS ({_MM} d8), b AS ({_MM} b12), f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, 0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0) AS score FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id) SELECT qid, id, round(score, 6) AS score, {RANKED} AS rank FROM f QUALIFY rank <= 5")
def weighted_hybrid(spark, sf_dir):
    """Five best of dense and lexical hits by weighted scores."""
    d, b = lists(spark, sf_dir)
    return R.weighted(d, b).where("rank <= 5").select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("mmr")
def mmr(spark, sf_dir):
    """Hybrid hits of every 20th vector and item, diversified: first max(4k, k + 5) by reciprocal ranks, then a greedy choice of k."""
    k = 5
    v = vectors(spark, sf_dir)
    hits = R.rrf(list(lists(spark, sf_dir))).where(F.col("rank") <= max(4 * k, k + 5))
    found = hits.join(v.select("id", "vec"), "id").join(asked_vectors(spark, sf_dir).withColumnRenamed("vec", "qvec"), "qid")
    return R.mmr(found, k)


@query("hybrid_retrieve")
def hybrid_retrieve(spark, sf_dir):
    """The whole chain in one call for queries that have a text and a vector: fused, diversified, reranked and summarised hits."""
    queries = asked(spark, sf_dir).join(asked_vectors(spark, sf_dir), "qid")
    return R.retrieve(vectors(spark, sf_dir), chunks(spark, sf_dir), queries).withColumn("score", F.round("score", 6))


#: Hits that stand for retrieval results: items as chunks of four queries.
HITS = "hits AS (SELECT item_id % 4 AS qid, item_id AS id, item_id % 7 AS doc_id, (item_id * 37 % 100) / 100.0::DOUBLE AS score, text, 'explain ' || left(text, 40) AS query FROM benchmark)"


def hits(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select((F.col("item_id") % 4).alias("qid"), F.col("item_id").alias("id"), (F.col("item_id") % 7).alias("doc_id"), (F.col("item_id") * 37 % 100 / F.lit(100.0)).alias("score"), "text", F.concat(F.lit("explain "), F.left("text", F.lit(40))).alias("query"))


@query("rerank_terms", rf"WITH {HITS}, w AS (SELECT qid, id, text, lower(text) AS t, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: regexp_full_match(x, '\p{{L}}+')) AS ws FROM hits), s AS (SELECT qid, id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(ws, lambda x: 2.0 * ln(1 + (length(t) - length(replace(t, x, ''))) / length(x)::DOUBLE))), 0) / ln(greatest(20, length(text))) END AS score FROM w) SELECT qid, id, round(score, 6) AS score, {RANKED} AS rank FROM s QUALIFY rank <= 5")
def rerank_terms(spark, sf_dir):
    """Hits reranked by the words of their query."""
    s = hits(spark, sf_dir).select("qid", "id", R.term_score(F.col("query"), F.col("text")).alias("score"))
    return R.top(s, 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("summaries", rf"""WITH RECURSIVE {HITS}, p AS (SELECT id, {_SENT} AS ss, {_TOK.format('query')} AS q FROM hits), e AS (SELECT id, i, ss[i] AS s, {_TOK.format('ss[i]')} AS w, q FROM p, unnest(range(1, len(ss) + 1)) AS u(i)),
c AS (SELECT id, s, len(w) AS n, round(len(list_filter(w, lambda x: list_contains(q, x))) / sqrt(len(w)), 9) AS sc, i FROM e WHERE len(w) > 0), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, i) AS r FROM c WHERE sc > 0),
f AS (SELECT id, 0 AS r, 0::BIGINT AS used, []::VARCHAR[] AS chosen FROM p UNION ALL SELECT f.id, f.r + 1, CASE WHEN used + n <= 25 AND len(chosen) < 3 THEN used + n ELSE used END, CASE WHEN used + n <= 25 AND len(chosen) < 3 THEN list_append(chosen, s) ELSE chosen END FROM f JOIN o ON o.id = f.id AND o.r = f.r + 1),
l AS (SELECT id, max_by(chosen, r) AS chosen FROM f GROUP BY id) SELECT p.id, CASE WHEN len(chosen) > 0 THEN array_to_string(chosen, ' ') ELSE coalesce(ss[1], '') END AS summary FROM p JOIN l ON p.id = l.id""")
def summaries(spark, sf_dir):
    """Extractive summary of each hit, within 25 tokens."""
    return hits(spark, sf_dir).select("id", R.summary(F.col("query"), F.col("text"), 25).alias("summary"))


@query("keyword_overlap", r"WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS tw, list_distinct([lower(source), 'the']) AS tt, [lang] AS sw FROM documents), q AS (SELECT ['the', 'of', 'en', 'thanea.', 'src3'] AS q), s AS (SELECT doc_id, (len(list_intersect(q, tw)) + 2 * len(list_intersect(q, tt)) + 1.5 * len(list_intersect(q, sw))) / len(q) AS score FROM d, q) SELECT doc_id, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0.1 ORDER BY score DESC, doc_id LIMIT 4")
def keyword_overlap(spark, sf_dir):
    """Four best documents by words shared with text, title and section."""
    q = F.array(*map(F.lit, ["the", "of", "en", "thanea.", "src3"]))
    shared = lambda w: F.size(F.array_intersect(q, w))
    text, title, section = T.words(F.lower("text")), F.array(F.lower("source"), F.lit("the")), F.array("lang")
    d = documents(spark, sf_dir).select("doc_id", ((shared(text) + 2 * shared(title) + 1.5 * shared(section)) / 5).alias("score"))
    return d.where("score > 0.1").orderBy(F.col("score").desc(), "doc_id").limit(4).select("doc_id", F.round("score", 6).alias("score"))


@query("retrieve_union", f"WITH q AS (SELECT item_id * 2 + x AS qid, item_id, CASE x WHEN 0 THEN text ELSE 'overview of ' || text END AS text FROM benchmark, (VALUES (0), (1)) AS v(x) WHERE item_id % 20 = 0), {BM25}, b AS (SELECT qid, id, {RANKED} AS rank FROM bm QUALIFY rank <= 8), f AS (SELECT q.item_id, id, sum(1.0 / (60 + rank)) AS score, min((b.qid, rank)) AS first FROM b JOIN q ON q.qid = b.qid GROUP BY 1, 2) SELECT item_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, first) AS rank FROM f QUALIFY rank <= 6")
def retrieve_union(spark, sf_dir):
    """Hits of a focused query and its expansion, fused by reciprocal ranks: one job over all queries."""
    b = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    q = b.select((F.col("item_id") * 2).alias("qid"), "text").unionByName(b.select((F.col("item_id") * 2 + 1).alias("qid"), F.concat(F.lit("overview of "), F.col("text")).alias("text")))
    found = R.bm25(chunks(spark, sf_dir), q, 8).withColumn("plan", F.floor(F.col("qid") / 2))
    each = [found.where(F.col("qid") % 2 == i).select(F.col("plan").alias("qid"), "id", "rank") for i in (0, 1)]
    return R.rrf(each).where("rank <= 6").select(F.col("qid").alias("item_id"), "id", F.round("score", 6).alias("score"), "rank")


@query("idf", rf"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln(max(n) / (count(*) + 1.0)), 6) AS idf FROM t, n GROUP BY term")
def idf(spark, sf_dir):
    """Document frequency and idf of every term."""
    d = documents(spark, sf_dir)
    df = d.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))), F.lit(True)).select("term", "df", F.round(F.log(F.col("n") / (F.col("df") + 1.0)), 6).alias("idf"))  # one row
