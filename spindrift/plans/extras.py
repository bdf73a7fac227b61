"""Further queries: leader clusters, answer strategies, fallbacks, source tables, budgets and failure policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import classify
from spindrift.operators import dedup as D
from spindrift.plans.dedup import _NEAR, SIM, hashes
from spindrift.plans.registry import query
from spindrift.plans.retrieval import HITS, hits
from spindrift.session import table


#: Nodes in the order of ids; the leaders so far grow by each node that has none of them among its earlier near ones.
@query("leader_clusters", f"""WITH RECURSIVE {SIM}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sim a JOIN sim b ON a.doc_id < b.doc_id AND {_NEAR} <= 8),
v AS (SELECT a AS id FROM p UNION SELECT b FROM p), k AS (SELECT v.id, row_number() OVER (ORDER BY v.id) AS k, coalesce(x.near, []) AS near FROM v LEFT JOIN (SELECT b AS id, list(a) AS near FROM p GROUP BY b) x USING (id)),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS led UNION ALL SELECT k.k, CASE WHEN len(list_intersect(k.near, r.led)) = 0 THEN list_append(r.led, k.id::BIGINT) ELSE r.led END FROM r JOIN k ON k.k = r.k + 1),
l AS (SELECT led FROM r ORDER BY k DESC LIMIT 1) SELECT coalesce(list_min(list_intersect(near, led)), id)::BIGINT AS leader, count(*) AS members FROM k, l GROUP BY 1""")
def leader_clusters(spark, sf_dir):
    """Greedy leader clusters of near-duplicates, in the order of ids."""
    found = D.leader_of(hashes(spark, sf_dir), "doc_id", 8)
    return found.groupBy("leader").agg(F.count(F.lit(1)).alias("members"))


_OPEN = "CASE WHEN contains(q, 'was ist') OR contains(q, 'definition') OR contains(q, 'bedeutung') THEN 'Basierend auf den Dokumenten: ' WHEN contains(q, 'wie') OR contains(q, 'warum') OR contains(q, 'wann') THEN 'Laut den verfügbaren Informationen: ' WHEN contains(q, 'kosten') OR contains(q, 'preis') OR contains(q, 'beitrag') THEN 'Zu den Kosten: ' ELSE 'Zu Ihrer Frage: ' END"


@query("fallback_answer", f"WITH {HITS}, b AS (SELECT qid, max_by(text, (score, -id)) AS text, ['Was ist das?', 'WIE geht das', 'Preis?', 'Sonst'][(qid + 1)::INT] AS question FROM hits GROUP BY qid), o AS (SELECT qid, text, lower(question) AS q FROM b) SELECT qid, {_OPEN} || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS answer FROM o")
def fallback_answer(spark, sf_dir):
    """Best hit's text with an opening that suits the question."""
    best = hits(spark, sf_dir).groupBy("qid").agg(F.max_by("text", F.struct("score", -F.col("id"))).alias("text"))
    q = F.lower(F.get(F.array(*map(F.lit, ["Was ist das?", "WIE geht das", "Preis?", "Sonst"])), F.col("qid").cast("int")))
    has = lambda *ws: sum((F.contains(q, F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0
    opening = F.when(has("was ist", "definition", "bedeutung"), "Basierend auf den Dokumenten: ").when(has("wie", "warum", "wann"), "Laut den verfügbaren Informationen: ").when(has("kosten", "preis", "beitrag"), "Zu den Kosten: ").otherwise("Zu Ihrer Frage: ")
    return best.select("qid", F.concat(opening, T.preview(F.col("text"), 500)).alias("answer"))


@query("sources_table", f"WITH {HITS} SELECT row_number() OVER (PARTITION BY qid ORDER BY score DESC, h.id) AS source, qid, h.id::VARCHAR AS chunk_id, h.doc_id, coalesce(d.source, '') AS title, '' AS section, h.score FROM hits h LEFT JOIN documents d ON d.doc_id = h.doc_id AND d.lang = 'en'")
def sources_table(spark, sf_dir):
    """Numbered sources of each query; what is missing is empty."""
    from spindrift.operators.retrieval import top

    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source")
    ranked = top(hits(spark, sf_dir), 2**31 - 1).withColumnRenamed("rank", "place")
    return ranked.join(d, "doc_id", "left").select(F.col("place").alias("source"), "qid", F.col("id").cast("string").alias("chunk_id"), "doc_id", F.coalesce("source", F.lit("")).alias("title"), F.lit("").alias("section"), "score")


_TERMS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query("answer_comparison", rf"WITH {HITS}, p AS (SELECT qid, id, text, {_TERMS.format('query')} AS q, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss FROM hits), r AS (SELECT qid, id, list_filter(ss, lambda s: len(list_intersect({_TERMS.format('s')}, q)) > 0)[1:2] AS rs FROM p) SELECT qid, id, array_to_string(rs, ' ') AS paragraph FROM r WHERE len(rs) > 0")
def answer_comparison(spark, sf_dir):
    """A paragraph for each source: its first two sentences with a word of the query."""
    parts = F.filter(F.transform(F.split("text", r"[.!?]+"), T.strip), lambda s: s != "")
    h = hits(spark, sf_dir).select("qid", "id", F.array_distinct(T.tokens(F.col("query"))).alias("q"), F.explode(F.array(parts)).alias("ss"))  # exploded, so that both are columns in the lambda
    chosen = F.slice(F.filter("ss", lambda s: F.arrays_overlap(T.tokens(s), F.col("q"))), 1, 2)
    return h.select("qid", "id", chosen.alias("rs")).where(F.size("rs") > 0).select("qid", "id", F.array_join("rs", " ").alias("paragraph"))


@query("failure_policy", "WITH b AS (SELECT event_id, user_id, event_id % 11 = 0 AS failed, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 8 END AS label, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE (event_id % 100) / 100.0 END AS conf FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE failed) AS failures, sum(label)::BIGINT AS labels, round(avg(conf), 6) AS mean_confidence, count(*) FILTER (WHERE failed) > 5 AS aborted FROM b GROUP BY user_id")
def failure_policy(spark, sf_dir):
    """Failed predictions count with label 0 and confidence 0; more than five failures abort."""
    failed = F.col("event_id") % 11 == 0
    b = table(spark, sf_dir, "events").select("user_id", failed.alias("failed"), F.coalesce(F.when(~failed, F.col("event_id") % 8), F.lit(0)).alias("label"), F.coalesce(F.when(~failed, F.col("event_id") % 100 / F.lit(100.0)), F.lit(0.0)).alias("conf"))
    return b.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"), F.sum("label").alias("labels"), F.round(F.avg("conf"), 6).alias("mean_confidence"), (F.count_if("failed") > 5).alias("aborted"))


@query("tfidf_similarity", r"WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark), df AS (SELECT w, count(DISTINCT item_id) AS df FROM t GROUP BY w), v AS (SELECT item_id, w, count(*) * (ln((1.0 + max(n)) / (1 + max(df))) + 1) AS x FROM t JOIN df USING (w), n GROUP BY item_id, w), l AS (SELECT item_id, sqrt(sum(x * x)) AS l FROM v GROUP BY item_id) SELECT a.item_id AS a, a.item_id + 1 AS b, round(sum(a.x * b.x) / (max(la.l) * max(lb.l)), 6) AS similarity FROM v a JOIN v b ON b.item_id = a.item_id + 1 AND b.w = a.w JOIN l la ON la.item_id = a.item_id JOIN l lb ON lb.item_id = b.item_id GROUP BY a.item_id")
def tfidf_similarity(spark, sf_dir):
    """Cosine of smoothed TF-IDF vectors of neighbouring items that share a word."""
    b = table(spark, sf_dir, "benchmark")
    tf = b.select("item_id", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("item_id", "w").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))  # one row
    v = tf.join(df, "w").select("item_id", "w", (F.col("tf") * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    size = v.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    a = v.select(F.col("item_id").alias("a"), "w", F.col("x").alias("xa"))
    c = v.select((F.col("item_id") - 1).alias("a"), "w", F.col("x").alias("xb"))
    dot = a.join(c, ["a", "w"]).groupBy("a").agg(F.sum(F.col("xa") * F.col("xb")).alias("d"))
    sized = dot.join(size.select(F.col("item_id").alias("a"), F.col("l").alias("la")), "a").join(size.select((F.col("item_id") - 1).alias("a"), F.col("l").alias("lb")), "a")
    return sized.select("a", (F.col("a") + 1).alias("b"), F.round(F.col("d") / (F.col("la") * F.col("lb")), 6).alias("similarity"))


@query("message_trimming", r"WITH m AS (SELECT conv_id, list(4 + floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3)::BIGINT ORDER BY turn) AS c FROM conversations GROUP BY conv_id), d AS (SELECT conv_id, c, list_filter(range(0, len(c), 2), lambda k: len(c) - k >= 2 AND c[1] + coalesce(list_sum(c[k+2:]), 0) + 2 <= 150) AS fits FROM m) SELECT conv_id, CASE WHEN len(fits) > 0 THEN len(c) - fits[1] ELSE least(2, len(c)) END::BIGINT AS kept FROM d")
def message_trimming(spark, sf_dir):
    """Messages kept of each conversation: two at a time drop out after the first until 150 tokens hold the rest; the first and last stay."""
    cost = 4 + T.chat_tokens(F.col("text"))
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", cost.alias("c")))), lambda x: x["c"]).alias("c"))
    total = lambda k: F.aggregate(F.slice("c", k + 2, F.greatest(F.lit(0), F.size("c") - k - 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    fits = F.filter(F.sequence(F.lit(0), F.size("c") - 1, F.lit(2)), lambda k: (F.size("c") - k >= 2) & (F.get("c", F.lit(0)) + total(k) + 2 <= 150))
    return m.select("conv_id", F.when(F.size(fits) > 0, F.size("c") - F.get(fits, F.lit(0))).otherwise(F.least(F.lit(2), F.size("c"))).cast("bigint").alias("kept"))


@query("chunk_entry")
def chunk_entry(spark, sf_dir):
    """Unified chunking: cohesive chunks of paged documents, budget chunks where a document is too short for them."""
    from spindrift.operators import chunking as C

    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: F.transform(T.sentences(x["text"]), lambda s: F.struct(x["turn"].alias("page"), s.alias("s")))))
    docs = per.select("conv_id", F.explode(F.array(flat)).alias("s")).withColumn("text", F.array_join("s.s", " "))
    short = T.approx_tokens(F.col("text")) < 20
    cohesive = C.semantic_chunks(docs.where(~short), "conv_id", C.hashing_embedder(), 480, 0.2).select("conv_id", "n", "text", F.lit("semantic").alias("method"))
    simple = C.token_chunks(docs.where(short).select("conv_id", "text"), "conv_id").select("conv_id", F.col("n").cast("long").alias("n"), "text", F.lit("simple").alias("method"))
    return cohesive.unionByName(simple)


def _by_article(texts: list[str]) -> list[tuple[str, float]]:
    """A stand-in for a model: the more often a text says `the`, the surer it is English. It fails on texts that hold an address."""
    if any("@" in t for t in texts):
        raise ValueError("address")
    return [("en" if (n := t.count(" the ")) else "other", min(1.0, n / 10) if n else 0.5) for t in texts]


_THE = "((length(text) - length(replace(text, ' the ', ''))) // 5)"


@query("classified_batches", f"""WITH c AS (SELECT lang, CASE WHEN trim(coalesce(text, '')) = '' THEN 'ValueError: empty text' WHEN contains(text, '@') THEN 'ValueError: address' END AS error, {_THE} AS n FROM documents),
l AS (SELECT lang, error, CASE WHEN error IS NULL THEN CASE WHEN n > 0 THEN 'en' ELSE 'other' END END AS label, CASE WHEN n > 0 THEN least(1.0, n / 10.0) ELSE 0.5 END AS confidence FROM c)
SELECT lang, coalesce(label, '') AS label, coalesce(error, '') AS error, count(*) AS n, round(coalesce(sum(confidence) FILTER (WHERE error IS NULL), 0), 4)::DOUBLE AS confidence FROM l GROUP BY ALL""")
def classified_batches(spark, sf_dir):
    """Texts by what a classifier says of them, the ones that it fails on by their error; a failing text does not take its batch along."""
    found = classify.classify(table(spark, sf_dir, "documents").select("lang", "text"), _by_article)
    named = found.groupBy("lang", F.coalesce("result.label", F.lit("")).alias("label"), F.coalesce("error", F.lit("")).alias("error"))
    return named.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("result.confidence"), F.lit(0.0)), 4).alias("confidence"))
