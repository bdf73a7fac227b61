"""Queries over the document store: scans, filters, upserts, joins and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spindrift.functions import filters
from spindrift.functions import text as T
from spindrift.operators import store as S
from spindrift.plans.registry import query
from spindrift.session import table

#: The store that the driver tables stand for: documents with labels and confidences, and their slices as chunks.
STORE = """store AS (SELECT doc_id, 'doc ' || doc_id AS title, source, lang, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS created_at, '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-15' AS date,
'{"predicted_label":"L' || (doc_id % 8) || '","predicted_confidence":0.' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '}' AS meta, text FROM documents)"""
CHUNKS = "chunks AS (SELECT doc_id, i, doc_id || '_chunk_' || i AS chunk_id, (i + 1)::BIGINT AS page, text[(i * 1000 + 1):(i * 1000 + 1000)] AS text FROM documents, unnest(range(0, (length(text) + 999) // 1000)) AS u(i))"


def store(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    meta = F.concat(F.lit('{"predicted_label":"L'), (F.col("doc_id") % 8).cast("string"), F.lit('","predicted_confidence":0.'), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("}"))
    created = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at")
    date = F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-15"))
    return d.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "source", "lang", created, date.alias("date"), meta.alias("meta"), "text")


def chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.slices(F.col("text"))).alias("i", "text"))
    return d.select("doc_id", "i", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("chunk_id"), (F.col("i") + 1).cast("bigint").alias("page"), "text")


def label():
    return F.get_json_object("meta", "$.predicted_label")


def confidence():
    return F.get_json_object("meta", "$.predicted_confidence").cast("double")


@query("metadata_filter", f"WITH {STORE} SELECT doc_id, title FROM store WHERE source IN ('src1', 'src2') AND lang = 'en' AND title <> 'doc 1' AND date::DATE >= DATE '2024-03-01' AND date::DATE <= DATE '2024-10-15'")
def metadata_filter(spark, sf_dir):
    """All forms of the filter language at once."""
    flt = {"source__in": ["src1", "src2"], "lang": "en", "title__ne": "doc 1", "date_gte": "2024-03-01", "date_lte": "2024-10-15"}
    return store(spark, sf_dir).where(filters.metadata_match(flt)).select("doc_id", "title")


@query("doc_search", f"WITH {STORE} SELECT doc_id, title, source FROM store WHERE (title ILIKE '%SRC3%' OR source ILIKE '%SRC3%') AND meta->>'predicted_label' = 'L3' AND (meta->>'predicted_confidence')::DOUBLE >= 0.2 ORDER BY created_at DESC LIMIT 10")
def doc_search(spark, sf_dir):
    """Newest documents whose title or source contains a text, by label and confidence."""
    like = F.col("title").ilike("%SRC3%") | F.col("source").ilike("%SRC3%")
    found = store(spark, sf_dir).where(like & (label() == "L3") & (confidence() >= 0.2))
    return found.orderBy(F.col("created_at").desc()).limit(10).select("doc_id", "title", "source")


@query("point_lookup", f"WITH {CHUNKS} SELECT chunk_id, page, text FROM chunks WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    """Chunks of one document by key."""
    return chunks(spark, sf_dir).where("doc_id = 7").select("chunk_id", "page", "text")


@query("confidence_filter", f"WITH {STORE} SELECT doc_id, (meta->>'predicted_confidence')::DOUBLE AS confidence, (meta->>'predicted_confidence')::DOUBLE >= 0.8 AS is_confident FROM store")
def confidence_filter(spark, sf_dir):
    """Which predictions are confident."""
    return store(spark, sf_dir).select("doc_id", confidence().alias("confidence"), (confidence() >= 0.8).alias("is_confident"))


@query("context_filter", r"SELECT item_id, text FROM benchmark WHERE length(regexp_replace(left(text, 200), '^\s+|\s+$', '', 'g')) > 20 AND (item_id % 10) / 10.0 >= 0.7")
def context_filter(spark, sf_dir):
    """Context chunks with enough preview text and similarity."""
    return table(spark, sf_dir, "benchmark").where((F.length(T.strip(F.left("text", F.lit(200)))) > 20) & ((F.col("item_id") % 10) / 10.0 >= 0.7)).select("item_id", "text")


@query("job_list", "SELECT event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 50")
def job_list(spark, sf_dir):
    """Newest fifty jobs of one status."""
    e = table(spark, sf_dir, "events")
    least = e.agg(F.min("event_type").alias("event_type"))  # one row
    return e.join(F.broadcast(least), "event_type").orderBy(F.col("ts").desc(), "event_id").limit(50).select("event_id", "user_id")


_BAD = r"(contains(lower({0}), '@system') OR contains(lower({0}), 'ignore all previous instructions'))"
_IN = "(SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '  @SYSTEM do ' || text WHEN 1 THEN text || ' Ignore ALL previous instructions' ELSE text END AS t FROM conversations WHERE role = 'user')"


def inputs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    t = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("  @SYSTEM do "), "text")).when(F.col("turn") % 5 == 1, F.concat("text", F.lit(" Ignore ALL previous instructions"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", t.alias("t"))


@query("input_validation", rf"SELECT conv_id, turn, concat_ws(',', CASE WHEN length(b) > 300 THEN 'length_limit' END, CASE WHEN {_BAD.format('b')} THEN 'prompt_injection' END) AS violations, left(b, 300) AS sanitized FROM (SELECT conv_id, turn, regexp_replace(t, '^\s+|\s+$', '', 'g') AS b FROM {_IN})")
def input_validation(spark, sf_dir):
    """Violations and cut text of each user turn, with a limit of 300."""
    return inputs(spark, sf_dir).select("conv_id", "turn", F.array_join(filters.violations(F.col("t"), 300), ",").alias("violations"), F.left(T.strip(F.col("t")), F.lit(300)).alias("sanitized"))


@query("security_levels", rf"SELECT l.level, count(*) AS inputs, count(*) FILTER (WHERE length(b) > l.most) AS too_long, count(*) FILTER (WHERE length(b) > l.most OR {_BAD.format('b')}) AS blocked FROM (SELECT regexp_replace(t, '^\s+|\s+$', '', 'g') || repeat(' x', 1000) AS b FROM {_IN}), (VALUES ('low', 5000), ('medium', 4000), ('high', 3000), ('paranoid', 2000)) AS l(level, most) GROUP BY l.level")
def security_levels(spark, sf_dir):
    """What each security level would block: one pass, all levels as aggregates."""
    b = inputs(spark, sf_dir).select(F.concat(T.strip(F.col("t")), F.repeat(F.lit(" x"), F.lit(1000))).alias("b"))
    found = b.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), filters.violations(F.col("b"), v[0]).alias("v")) for k, v in filters.LEVELS.items()))).alias("x")).select("x.*")
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("inputs"), F.count_if(F.array_contains("v", "length_limit")).alias("too_long"), F.count_if(F.size("v") > 0).alias("blocked"))


@query("upsert_validation", "SELECT count(*) AS rows, count(*) FILTER (WHERE embedding IS NULL OR vec_id IS NULL) AS missing, min(len(embedding))::BIGINT AS least_dim, max(len(embedding))::BIGINT AS most_dim, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AND count(*) > 0 AND count(*) FILTER (WHERE embedding IS NULL OR vec_id IS NULL) = 0 AS ok FROM embeddings")
def upsert_validation(spark, sf_dir):
    """Vectors to be indexed: none missing, one dimension, the index's."""
    missing = F.count_if(F.col("embedding").isNull() | F.col("vec_id").isNull())
    low, high = F.min(F.size("embedding")).cast("bigint"), F.max(F.size("embedding")).cast("bigint")
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing"), low.alias("least_dim"), high.alias("most_dim"), ((low == 64) & (high == 64) & (F.count(F.lit(1)) > 0) & (missing == 0)).alias("ok"))


@query("metadata_validation", f"WITH {STORE}, m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{{\"predicted_confidence\":1.5}}' ELSE meta END AS meta FROM store) SELECT doc_id, meta->>'predicted_label' IS NOT NULL AS has_label, coalesce((meta->>'predicted_confidence')::DOUBLE BETWEEN 0 AND 1, false) AS confidence_ok, coalesce(meta->>'predicted_label' IN ('L0','L1','L2','L3','L4'), false) AS label_known FROM m")
def metadata_validation(spark, sf_dir):
    """Required keys, range of the confidence, and labels of the list."""
    m = store(spark, sf_dir).withColumn("meta", F.when(F.col("doc_id") % 7 == 0, '{"predicted_confidence":1.5}').otherwise(F.col("meta")))
    known = ["L0", "L1", "L2", "L3", "L4"]
    return m.select("doc_id", label().isNotNull().alias("has_label"), F.coalesce(confidence().between(0, 1), F.lit(False)).alias("confidence_ok"), F.coalesce(label().isin(*known), F.lit(False)).alias("label_known"))


@query("field_normalise", "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id % 3 END, CASE WHEN user_id % 5 <> 0 THEN user_id % 5 END) AS category, coalesce(CASE WHEN event_id % 2 = 0 THEN NULLIF(event_type, '') END, 'u' || user_id) AS label FROM events")
def field_normalise(spark, sf_dir):
    """First truthy of aliases; 0 and empty texts are skipped."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", filters.first_truthy(F.col("event_id") % 3, F.col("user_id") % 5).alias("category"), filters.first_truthy(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(""), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("label"))


@query("request_bounds", "SELECT doc_id, length(text) BETWEEN 1 AND 50000 AS text_ok, length(text) % 6000 BETWEEN 100 AND 5000 AS chunk_ok FROM documents")
def request_bounds(spark, sf_dir):
    """Bounds of requests."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", n.between(1, 50000).alias("text_ok"), (n % 6000).between(100, 5000).alias("chunk_ok"))


@query("file_validation", "SELECT page_id, regexp_matches(lower(split_part(split_part(url, '?', 1), '#', 1)), '\\.html$') AND octet_length(encode(html)) <= 52428800 AS valid FROM pages")
def file_validation(spark, sf_dir):
    """Suffix and size of files."""
    bare = F.lower(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", (F.endswith(bare, F.lit(".html")) & (F.octet_length("html") <= 50 * 1024 * 1024)).alias("valid"))


@query("page_parallelism", "WITH d AS (SELECT conv_id, count(*) AS pages, avg(length(text)) FILTER (WHERE turn < 3) AS per_page FROM conversations GROUP BY conv_id) SELECT conv_id, pages, CASE WHEN pages <= 5 THEN false WHEN pages > 20 THEN true ELSE pages > 10 AND per_page > 1500 END AS parallel FROM d")
def page_parallelism(spark, sf_dir):
    """Whether a document's pages would be worth parallel work."""
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pages"), F.avg(F.when(F.col("turn") < 3, F.length("text"))).alias("per_page"))
    return d.select("conv_id", "pages", F.when(F.col("pages") <= 5, False).when(F.col("pages") > 20, True).otherwise((F.col("pages") > 10) & (F.col("per_page") > 1500)).alias("parallel"))


@query("resume_state", "WITH s AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id) SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = c_custkey AND s.status = 'click')")
def resume_state(spark, sf_dir):
    """Files still to do: the last state of each wins, those that are done drop out."""
    e = table(spark, sf_dir, "events")
    last = S.latest(e.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).where("event_type = 'click'")
    return table(spark, sf_dir, "customer").select("c_custkey").join(last.select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")


@query("page_assembly", r"SELECT conv_id, regexp_replace(string_agg(text, chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') AS text FROM conversations GROUP BY conv_id")
def page_assembly(spark, sf_dir):
    """Pages of a document joined by line breaks in order."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return c.select("conv_id", T.strip(F.array_join("p.text", "\n")).alias("text"))


@query("label_list", "SELECT DISTINCT trim(c_mktsegment) AS label FROM customer WHERE trim(c_mktsegment) <> ''")
def label_list(spark, sf_dir):
    """Labels without blanks and empty lines."""
    return table(spark, sf_dir, "customer").select(F.trim("c_mktsegment").alias("label")).where("label <> ''").distinct()


@query("store_upsert", f"WITH {STORE}, n AS (SELECT doc_id + 500 AS doc_id, upper(title) AS title, source FROM store) SELECT coalesce(n.doc_id, s.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN s.title ELSE n.title END AS title, CASE WHEN n.doc_id IS NULL THEN s.source ELSE n.source END AS source FROM store s FULL JOIN n ON s.doc_id = n.doc_id")
def store_upsert(spark, sf_dir):
    """Documents replaced or added."""
    s = store(spark, sf_dir).select("doc_id", "title", "source")
    return S.upsert(s, s.select((F.col("doc_id") + 500).alias("doc_id"), F.upper("title").alias("title"), "source"), "doc_id")


@query("chunk_insert", f"WITH {CHUNKS} SELECT chunk_id, doc_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE i = 0)")
def chunk_insert(spark, sf_dir):
    """Chunks that the store has not."""
    c = chunks(spark, sf_dir)
    return S.insert_only(c.where("i = 0"), c.select("chunk_id", "doc_id"), "chunk_id")


@query("metadata_merge", "SELECT c_custkey, string_agg(k || '=' || v, ',' ORDER BY k) AS meta FROM (SELECT c_custkey, 'seg' AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'seg', 'NEW' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'name', c_name FROM customer UNION ALL SELECT c_custkey, 'x', '1' FROM customer WHERE c_custkey % 2 = 0) GROUP BY c_custkey")
def metadata_merge(spark, sf_dir):
    """Right-biased merge of metadata, null values dropped."""
    c = table(spark, sf_dir, "customer")
    even = F.col("c_custkey") % 2 == 0
    new = S.without_nulls(F.create_map(F.lit("seg"), F.when(even, "NEW"), F.lit("x"), F.when(even, "1")))
    merged = S.merge_maps(F.create_map(F.lit("seg"), "c_mktsegment", F.lit("name"), "c_name"), new)
    return c.select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("meta"))


@query("fixed_slices", f"WITH {CHUNKS} SELECT chunk_id, doc_id, page, length(text)::BIGINT AS n_chars, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM chunks")
def fixed_slices(spark, sf_dir):
    """Thousand-character slices with previews."""
    return chunks(spark, sf_dir).select("chunk_id", "doc_id", "page", F.length("text").cast("bigint").alias("n_chars"), T.preview(F.col("text"), 200).alias("preview"))


@query("file_hash_dedup", "SELECT d.doc_id FROM documents d WHERE sha256(d.text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def file_hash_dedup(spark, sf_dir):
    """Files whose hash the store has not seen."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.where("doc_id % 2 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("hit_store_join", f"WITH {CHUNKS}, h AS (SELECT vec_id, vec_id || '_chunk_0' AS chunk_id FROM embeddings WHERE vec_id % 3 = 0) SELECT h.vec_id, c.chunk_id, length(c.text)::BIGINT AS n_chars FROM h JOIN chunks c ON h.chunk_id = c.chunk_id")
def hit_store_join(spark, sf_dir):
    """Hits with their chunks; hits without one drop out."""
    h = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select("vec_id", F.concat(F.col("vec_id").cast("string"), F.lit("_chunk_0")).alias("chunk_id"))
    return h.join(chunks(spark, sf_dir), "chunk_id").select("vec_id", "chunk_id", F.length("text").cast("bigint").alias("n_chars"))


@query("similar_left_join", f"WITH {CHUNKS} SELECT e.vec_id, c.text IS NOT NULL AS found FROM embeddings e LEFT JOIN chunks c ON c.chunk_id = (e.vec_id * 3) || '_chunk_0'")
def similar_left_join(spark, sf_dir):
    """Hits with their chunks; hits without one stay."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat((F.col("vec_id") * 3).cast("string"), F.lit("_chunk_0")).alias("chunk_id"))
    return e.join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id", "left").select("vec_id", F.col("text").isNotNull().alias("found"))


@query("chunk_listing", f"WITH {STORE}, {CHUNKS} SELECT c.chunk_id, s.title, substring(c.text, 1, 100) AS head FROM chunks c LEFT JOIN store s ON c.doc_id = s.doc_id AND s.doc_id % 2 = 0")
def chunk_listing(spark, sf_dir):
    """Chunks with their documents' titles."""
    s = store(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", "title")
    return chunks(spark, sf_dir).join(s, "doc_id", "left").select("chunk_id", "title", F.substring("text", 1, 100).alias("head"))


@query("integrity", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS childless, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)) AS orphans, (SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = '') AS empty_texts")
def integrity(spark, sf_dir):
    """Parents without children, children without parents, empty texts; three counts, no row collected."""
    o, li, d = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "documents"))
    childless = o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("childless"))
    orphans = li.join(o.where("o_orderkey % 2 = 0"), o.o_orderkey == li.l_orderkey, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("orphans"))
    empty = d.agg(F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("n")).withColumn("what", F.lit("empty_texts"))
    found = childless.unionByName(orphans).unionByName(empty)
    return found.agg(*(F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("childless", "orphans", "empty_texts")))


@query("label_stats", f"WITH {STORE} SELECT meta->>'predicted_label' AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share, round(avg((meta->>'predicted_confidence')::DOUBLE), 6) AS mean_confidence, min((meta->>'predicted_confidence')::DOUBLE) AS least, max((meta->>'predicted_confidence')::DOUBLE) AS most FROM store GROUP BY 1")
def label_stats(spark, sf_dir):
    """Count, share and confidences by label; the total is a window over one row for each label."""
    g = store(spark, sf_dir).groupBy(label().alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(confidence()), 6).alias("mean_confidence"), F.min(confidence()).alias("least"), F.max(confidence()).alias("most"))
    return g.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 6))


@query("store_stats", f"WITH {STORE} SELECT source, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, count(*) FILTER (WHERE meta IS NOT NULL) AS with_meta FROM store GROUP BY source")
def store_stats(spark, sf_dir):
    """Documents by source."""
    return store(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count("meta").alias("with_meta"))


@query("chunk_page_stats", f"WITH {CHUNKS}, p AS (SELECT page, count(*) AS n FROM chunks GROUP BY page ORDER BY n DESC, page LIMIT 10), d AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT p.page, p.n, (SELECT round(avg(n), 6) FROM d) AS per_doc, (SELECT round(avg(length(text)), 6) FROM chunks) AS mean_chars, (SELECT min(length(text)) FROM chunks)::BIGINT AS least_chars, (SELECT max(length(text)) FROM chunks)::BIGINT AS most_chars FROM p")
def chunk_page_stats(spark, sf_dir):
    """Ten most frequent pages, with averages over documents and chunks."""
    c = chunks(spark, sf_dir).select("doc_id", "page", F.length("text").alias("n"))
    per = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    whole = per.agg(F.round(F.avg("k"), 6).alias("per_doc"), F.round(F.sum("s") / F.sum("k"), 6).alias("mean_chars"), F.min("lo").cast("bigint").alias("least_chars"), F.max("hi").cast("bigint").alias("most_chars")).withColumn("one", F.lit(1))
    top = c.groupBy("page").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "page").limit(10).withColumn("one", F.lit(1))
    return top.join(F.broadcast(whole), "one").drop("one")  # one row


@query("distinct_labels", f"WITH {STORE} SELECT DISTINCT meta->>'predicted_label' AS label FROM store")
def distinct_labels(spark, sf_dir):
    """Labels in the store."""
    return store(spark, sf_dir).select(label().alias("label")).distinct()


@query("namespace_stats", "SELECT 'ns-' || label AS namespace, count(*) AS vectors FROM embeddings GROUP BY label")
def namespace_stats(spark, sf_dir):
    """Vectors by namespace."""
    return table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("ns-"), F.col("label").cast("string")).alias("namespace")).agg(F.count(F.lit(1)).alias("vectors"))


@query("similar_rollup", "SELECT source, round(avg((doc_id % 100) / 100.0), 6) AS mean_score, count(*) AS hits FROM documents WHERE source <> 'src1' GROUP BY source ORDER BY avg((doc_id % 100) / 100.0) DESC, source LIMIT 5")
def similar_rollup(spark, sf_dir):
    """Best five other sources by mean score."""
    g = table(spark, sf_dir, "documents").where("source <> 'src1'").groupBy("source").agg(F.avg((F.col("doc_id") % 100) / 100.0).alias("m"), F.count(F.lit(1)).alias("hits"))
    return g.orderBy(F.round("m", 9).desc(), "source").limit(5).select("source", F.round("m", 6).alias("mean_score"), "hits")


@query("conversation_stats", r"SELECT conv_id, count(*) AS turns, sum(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3))::BIGINT AS tokens, count(*) FILTER (WHERE role = 'user') AS questions, min(turn) AS first_turn, max(turn) AS last_turn, round(avg(length(text)) FILTER (WHERE role = 'assistant'), 6) AS mean_answer FROM conversations GROUP BY conv_id")
def conversation_stats(spark, sf_dir):
    """Turns, tokens and answers of each conversation."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(T.chat_tokens(F.col("text"))).alias("tokens"), F.count_if(F.col("role") == "user").alias("questions"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.round(F.avg(F.when(F.col("role") == "assistant", F.length("text"))), 6).alias("mean_answer"))


@query("session_stats", "SELECT user_id, count(*) AS requests, round(sum(value), 4) AS tokens, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (WHERE event_type = 'error') AS violations FROM events GROUP BY user_id")
def session_stats(spark, sf_dir):
    """Activity of each user."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 4).alias("tokens"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(F.col("event_type") == "error").alias("violations"))


@query("latency_histogram", "SELECT event_type, CASE WHEN value <= 1 THEN '1' WHEN value <= 5 THEN '5' WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' ELSE 'inf' END AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    """Counts by label and bucket."""
    v = F.col("value")
    bucket = F.lit("inf")
    for b in (100, 50, 10, 5, 1):
        bucket = F.when(v <= b, str(b)).otherwise(bucket)
    return table(spark, sf_dir, "events").groupBy("event_type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("final_confidence", f"WITH {STORE}, q AS (SELECT doc_id, (meta->>'predicted_confidence')::DOUBLE AS c, least(1.0, length(text) / 1000.0) AS quality FROM store), f AS (SELECT *, round((c + c + quality) / 3, 9) AS final FROM q) SELECT doc_id, round(final, 6) AS final, CASE WHEN final > 0.8 THEN 'accept' WHEN final > 0.6 THEN 'review' ELSE 'reject' END AS recommendation FROM f")
def final_confidence(spark, sf_dir):
    """Mean of the factors, the confidence counting twice, and what it recommends."""
    q = store(spark, sf_dir).select("doc_id", confidence().alias("c"), F.least(F.lit(1.0), F.length("text") / 1000.0).alias("quality"))
    final = F.round((F.col("c") + F.col("c") + F.col("quality")) / 3, 9)
    return q.select("doc_id", F.round(final, 6).alias("final"), F.when(final > 0.8, "accept").when(final > 0.6, "review").otherwise("reject").alias("recommendation"))


@query("quality_metrics", r"SELECT doc_id, length(text)::BIGINT AS n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS n_words, least(1.0, length(text) / 1000.0)::DOUBLE AS quality FROM documents")
def quality_metrics(spark, sf_dir):
    """Length, words and text quality."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"), F.least(F.lit(1.0), F.length("text") / 1000.0).alias("quality"))


@query("dedup_exact", r"WITH k AS (SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS key FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM k WHERE length(key) > 10 GROUP BY key")
def dedup_exact(spark, sf_dir):
    """First document of each trimmed lower-cased text of over ten characters; grouped by hash, so texts stay out of the shuffle."""
    key = F.lower(T.strip(F.col("text")))
    rows = table(spark, sf_dir, "documents").where(F.length(key) > 10).select("doc_id", F.sha2(key, 256).alias("key"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("last_n_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_turns(spark, sf_dir):
    """Last three turns of each conversation."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return table(spark, sf_dir, "conversations").withColumn("r", rank).where("r <= 3").select("conv_id", "turn", "role")


@query("last_user_turn", "SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_turn(spark, sf_dir):
    """Latest user turn of each conversation."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("newest_first", f"WITH {STORE} SELECT doc_id, created_at FROM store ORDER BY created_at DESC LIMIT 10")
def newest_first(spark, sf_dir):
    """Ten newest documents."""
    return store(spark, sf_dir).select("doc_id", "created_at").orderBy(F.col("created_at").desc()).limit(10)


@query("jaccard", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0 WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END, 6) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def jaccard(spark, sf_dir):
    """Token similarity of neighbouring items."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    a, b = t.alias("a"), t.alias("b")
    both, any_ = F.size(F.array_intersect("a.w", "b.w")), F.size(F.array_union("a.w", "b.w"))
    score = F.when((F.size("a.w") == 0) & (F.size("b.w") == 0), 1.0).when((F.size("a.w") == 0) | (F.size("b.w") == 0), 0.0).otherwise(both / any_)
    return a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(score, 6).alias("jaccard"))
