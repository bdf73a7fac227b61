"""Queries of chunking and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spindrift.functions import text as T
from spindrift.operators import chunking as C
from spindrift.plans.registry import query
from spindrift.plans.text import APPROX, SENTS
from spindrift.session import documents, table

_SENT_ROWS = f"s AS (SELECT doc_id, i, ss[i] AS s, {APPROX.format('ss[i]')} AS cost FROM (SELECT doc_id, {SENTS} AS ss FROM documents), unnest(range(1, len(ss) + 1)) AS u(i))"
_TOKEN_FOLD = """f AS (SELECT doc_id, 1::BIGINT AS i, 1::BIGINT AS a, cost AS used, 0::BIGINT AS n, cost AS prev FROM s WHERE i = 1
UNION ALL SELECT f.doc_id, s.i, CASE WHEN used + s.cost > {most} THEN s.i - 1 ELSE a END, CASE WHEN used + s.cost > {most} THEN prev + s.cost ELSE used + s.cost END, CASE WHEN used + s.cost > {most} THEN n + 1 ELSE n END, s.cost FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)"""


@query("chunks_tokens", f"WITH RECURSIVE {_SENT_ROWS}, {_TOKEN_FOLD.format(most=120)} SELECT doc_id, n, (max(i) - min(a) + 1)::BIGINT AS n_sentences, max(used)::BIGINT AS tokens FROM f GROUP BY doc_id, n")
def chunks_tokens(spark, sf_dir):
    """Token-budget chunks with one sentence of overlap."""
    c = C.token_chunks(documents(spark, sf_dir), "doc_id", 120, 1)
    return c.select("doc_id", F.col("n").cast("bigint").alias("n"), (F.col("b") - F.col("a")).cast("bigint").alias("n_sentences"), "tokens")


@query("chunks_chars", r"""WITH RECURSIVE s AS (SELECT doc_id, i, ss[i] AS s, length(ss[i]) AS len FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) AS ss FROM documents), unnest(range(1, len(ss) + 1)) AS u(i)),
f AS (SELECT doc_id, 1::BIGINT AS i, len + 1 AS used, 0::BIGINT AS n, [len] AS cur FROM s WHERE i = 1
UNION ALL SELECT doc_id, i, CASE WHEN cut THEN coalesce(list_sum(kept), 0) ELSE used END + len + 1, CASE WHEN cut THEN n + 1 ELSE n END, list_append(CASE WHEN cut THEN kept ELSE cur END, len) FROM (
SELECT f.doc_id, s.i, used, n, cur, s.len, used + s.len + 1 > 400 AS cut, list_filter(cur, lambda x, k: list_sum(cur[k:]) < 60) AS kept FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1))
SELECT doc_id, n, max(len(cur))::BIGINT AS n_sentences, max(list_sum(cur) + len(cur) - 1)::BIGINT AS n_chars FROM f GROUP BY doc_id, n""")
def chunks_chars(spark, sf_dir):
    """Character-budget chunks of sentences, with trailing sentences of under 60 characters as overlap."""
    d = documents(spark, sf_dir).select("doc_id", F.split("text", r"(?<=[.!?])\s+").alias("s"))
    lengths = F.transform("s", lambda x: F.length(x).cast("bigint"))
    spans = d.select("doc_id", "s", F.posexplode(C.char_spans(lengths, 400, 60)).alias("n", "x"))
    return spans.select("doc_id", F.col("n").cast("bigint").alias("n"), (F.col("x.b") - F.col("x.a")).cast("bigint").alias("n_sentences"), F.length(C.joined(F.col("s"), F.col("x"))).cast("bigint").alias("n_chars"))


@query("chunks_pages", rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, {SENTS} AS ss FROM conversations), r AS (SELECT conv_id, turn, ss[k] AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS i FROM t, unnest(range(1, len(ss) + 1)) AS u(k)), s AS (SELECT conv_id AS doc_id, turn, i, {APPROX.format('s')} AS cost FROM r),
{_TOKEN_FOLD.format(most=60)}, c AS (SELECT doc_id, n, min(a) AS a, max(i) AS b, max(used) AS tokens FROM f GROUP BY doc_id, n)
SELECT c.doc_id || '_simple_' || c.n AS chunk_id, min(turn) AS page_start, max(turn) AS page_end, min(turn) = max(turn) AS one_page, count(*) AS n_sentences, max(tokens)::BIGINT AS tokens FROM c JOIN s ON s.doc_id = c.doc_id AND s.i BETWEEN c.a AND c.b GROUP BY c.doc_id, c.n""")
def chunks_pages(spark, sf_dir):
    """Token-budget chunks over the pages of a document."""
    c = C.page_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", 60, 1)
    return c.select("chunk_id", "page_start", "page_end", "one_page", "n_sentences", "tokens")


@query("chunk_stats", f"WITH RECURSIVE {_SENT_ROWS}, {_TOKEN_FOLD.format(most=480)}, c AS (SELECT doc_id, n, max(i) - min(a) + 1 AS k, max(used) AS tokens FROM f GROUP BY doc_id, n) SELECT count(*) AS chunks, round(avg(tokens), 6) AS mean_tokens, min(tokens)::BIGINT AS least, max(tokens)::BIGINT AS most, round(avg(k), 6) AS mean_sentences, count(DISTINCT doc_id) AS documents FROM c")
def chunk_stats(spark, sf_dir):
    """Statistics of all chunks in one aggregate."""
    c = C.token_chunks(documents(spark, sf_dir), "doc_id", 480, 1)
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_sentences"), F.count_distinct("doc_id").alias("documents"))


_SEC = "(SELECT p_partkey, [NULL, '1', '1.2', '1.2.3.', '1.2.3.4.5.6.7.8', '', '2.1'][(p_partkey % 7 + 1)::INT] AS section, ['Summary of it', 'Other', NULL, 'FAZIT'][(p_partkey % 4 + 1)::INT] AS title FROM part)"


@query("chunk_importance", f"SELECT p_partkey, round(least(1.5, CASE WHEN section IS NULL OR section = '' THEN 1.0 ELSE greatest(0.5, 1.0 - 0.1 * (len(list_filter(string_split(section, '.'), lambda p: p <> '')) - 1)) END + CASE WHEN len(list_filter(['introduction','conclusion','summary','abstract','einleitung','zusammenfassung','fazit'], lambda w: contains(lower(coalesce(title, '')), w))) > 0 THEN 0.2 ELSE 0.0 END)::DOUBLE, 6) AS importance, array_to_string(list_concat(list_transform(range(1, len(list_filter(string_split(coalesce(section, ''), '.'), lambda p: p <> '')) + 1), lambda i: array_to_string(list_filter(string_split(section, '.'), lambda p: p <> '')[1:i], '.')), CASE WHEN title IS NULL THEN [] ELSE [title] END), ' > ') AS path FROM {_SEC}")
def chunk_importance(spark, sf_dir):
    """Importance and heading path by section and title."""
    pick = lambda values, n: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("p_partkey") % n).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", pick([None, "1", "1.2", "1.2.3.", "1.2.3.4.5.6.7.8", "", "2.1"], 7).alias("section"), pick(["Summary of it", "Other", None, "FAZIT"], 4).alias("title"))
    return p.select("p_partkey", F.round(C.importance(F.col("section"), F.col("title")), 6).alias("importance"), F.array_join(C.heading_path(F.coalesce("section", F.lit("")), F.col("title")), " > ").alias("path"))


@query("chunk_strategy", f"WITH RECURSIVE {_SENT_ROWS}, {_TOKEN_FOLD.format(most=480)}, c AS (SELECT f.doc_id, f.n, min(a) AS a, max(i) AS b FROM f WHERE f.doc_id % 3 > 0 GROUP BY f.doc_id, f.n), x AS (SELECT c.doc_id, c.n, string_agg(s.s, ' ' ORDER BY s.i) AS text FROM c JOIN s ON s.doc_id = c.doc_id AND s.i BETWEEN c.a AND c.b GROUP BY c.doc_id, c.n) SELECT doc_id, 0::BIGINT AS n, 'none' AS strategy, length(text)::BIGINT AS n_chars, 1.0::DOUBLE AS importance FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, n, CASE doc_id % 3 WHEN 1 THEN 'simple' ELSE 'hybrid' END, length(text)::BIGINT, CASE WHEN doc_id % 3 = 2 AND length(text) > 500 THEN 1.2 ELSE 1.0 END FROM x")
def chunk_strategy(spark, sf_dir):
    """Strategy by document: whole, simple, or hybrid with long chunks more important; one union of branches."""
    d = documents(spark, sf_dir)
    whole = d.where("doc_id % 3 = 0").select("doc_id", F.lit(0).cast("bigint").alias("n"), F.lit("none").alias("strategy"), F.length("text").cast("bigint").alias("n_chars"), F.lit(1.0).alias("importance"))
    c = C.token_chunks(d.where("doc_id % 3 > 0"), "doc_id", 480, 1)
    hybrid = F.col("doc_id") % 3 == 2
    cut = c.select("doc_id", F.col("n").cast("bigint").alias("n"), F.when(hybrid, "hybrid").otherwise("simple").alias("strategy"), F.length("text").cast("bigint").alias("n_chars"), F.when(hybrid & (F.length("text") > 500), 1.2).otherwise(1.0).alias("importance"))
    return whole.unionByName(cut)


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    """Cohesive chunks over pages, with the hashing embedder."""
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
    parts = F.flatten(F.transform("p", lambda x: F.transform(T.sentences(x["text"]), lambda s: F.struct(x["turn"].alias("page"), s.alias("s")))))
    return C.semantic_chunks(per.select("conv_id", parts.alias("s")), "conv_id", C.hashing_embedder(), 480, 0.2)


@query("seeded_embeddings")
def seeded_embeddings(spark, sf_dir):
    """Repeatable vectors of the items' texts, each distinct text once, joined back."""
    b = table(spark, sf_dir, "benchmark")
    return b.join(C.embed(b, "text", C.seeded_embedder()), "text").select("item_id", "vec")


@query("embedding_cache", "SELECT count(*) AS rows, count(DISTINCT text) AS embedded, count(*) - count(DISTINCT text) AS saved FROM documents")
def embedding_cache(spark, sf_dir):
    """What embedding each distinct text once saves; texts are counted by hash."""
    d = documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("embedded"), (F.sum("n") - F.count(F.lit(1))).alias("saved"))


@query("hashed_vectors", r"WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM benchmark), e AS (SELECT item_id, ('0x' || left(md5(unnest(w)), 6))::BIGINT % 32 AS dim FROM t) SELECT item_id, dim, count(*) AS n, round(count(*) / sqrt(sum(count(*) * count(*)) OVER (PARTITION BY item_id)), 6) AS value FROM e GROUP BY item_id, dim")
def hashed_vectors(spark, sf_dir):
    """Hashed term counts of unit length, as sparse rows."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.words(F.lower("text"))).alias("w"))
    dim = F.conv(F.left(F.md5("w"), F.lit(6)), 16, 10).cast("bigint") % 32
    n = w.groupBy("item_id", dim.alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("value", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("item_id"))), 6))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_avg(embedding::DOUBLE[]), 6) AS mean FROM embeddings")
def vector_norms(spark, sf_dir):
    """Norm and mean of each vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(total(F.transform(v, lambda x: x * x))), 6).alias("norm"), F.round(total(v) / F.size("embedding"), 6).alias("mean"))


@query("length_clusters", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), k AS (SELECT *, greatest(2, least(10, n // 5)) AS k FROM r) SELECT doc_id, least(floor(i / (n / k::DOUBLE))::BIGINT, k - 1) AS cluster FROM k")
def length_clusters(spark, sf_dir):
    """Clusters of equal size by length. Ranks come from counts by length, so no window gathers all documents in one task."""
    d = documents(spark, sf_dir).select("doc_id", F.length("text").alias("size"))
    counts = d.groupBy("size").agg(F.count(F.lit(1)).alias("c"))  # one row for each length
    before = counts.withColumn("before", F.sum("c").over(W.orderBy("size")) - F.col("c")).withColumn("n", F.sum("c").over(W.partitionBy()))
    i = F.col("before") + F.row_number().over(W.partitionBy("size").orderBy("doc_id")) - 1
    k = F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("n") / 5)))
    return d.join(before, "size").withColumn("i", i).select("doc_id", F.least(F.floor(F.col("i") / (F.col("n") / k)), k - 1).cast("bigint").alias("cluster"))


@query("kmeans")
def kmeans(spark, sf_dir):
    """K-means over the vectors, k by their number, with each cluster's size and the silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    k = max(2, min(10, v.count() // 5))
    found = KMeans(k=k, seed=42, maxIter=20).fit(v).transform(v)
    silhouette = ClusteringEvaluator().evaluate(found)
    return found.groupBy(F.col("prediction").cast("bigint").alias("cluster")).agg(F.count(F.lit(1)).alias("vectors")).withColumn("silhouette", F.round(F.lit(silhouette), 6))


@query("kmeans_tfidf")
def kmeans_tfidf(spark, sf_dir):
    """K-means over TF-IDF of the thousand most frequent words. Texts are cut into words twice, for the vocabulary and for the counts, and all passes of the fits read the counts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, StopWordsRemover

    d = documents(spark, sf_dir).select("doc_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    tf = C.term_counts(d, "doc_id", "words", C.frequent(d, "words", 1000, StopWordsRemover().getStopWords()))
    weighted = IDF(inputCol="tf", outputCol="features").fit(tf).transform(tf)
    found = KMeans(k=10, seed=42, maxIter=10).fit(weighted).transform(weighted)
    return found.select("doc_id", F.col("prediction").cast("bigint").alias("cluster"))


@query("ingest")
def ingest(spark, sf_dir):
    """Documents to chunks with vectors in one plan; the vectors' sums stand for them."""
    from spindrift.operators.ingest import ingest as run

    found = run(documents(spark, sf_dir), C.hashing_embedder(16))
    return found.select("doc_id", "chunk_id", "tokens", "language", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("weight"))
