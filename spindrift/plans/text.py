"""Queries over text columns of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.plans.registry import query
from spindrift.session import documents, table

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({strip}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: {strip_s}), lambda s: s <> '')"
SENTS = SENTENCES.format(strip=STRIP.format("text"), strip_s=STRIP.format("s"))
APPROX = r"greatest(1, round(len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')) / 1.3))::BIGINT"


def docs(spark, sf_dir):
    return documents(spark, sf_dir)


@query("token_counts", f"SELECT doc_id, {APPROX.format('text')} AS approx_tokens, floor(len({_WORDS}) * 1.3)::BIGINT AS chat_tokens, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))::BIGINT AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    """Both token approximations and the number of word tokens."""
    return docs(spark, sf_dir).select("doc_id", T.approx_tokens(F.col("text")).alias("approx_tokens"), T.chat_tokens(F.col("text")).alias("chat_tokens"), F.size(T.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query("message_tokens", r"""SELECT conv_id, sum(4 + floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3) + floor(len(list_filter(regexp_split_to_array(role, '\s+'), lambda w: w <> '')) * 1.3))::BIGINT + 2 AS tokens FROM conversations GROUP BY conv_id""")
def message_tokens(spark, sf_dir):
    """Tokens of a conversation: four for each message, its values, and two."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg((F.sum(4 + T.chat_tokens(F.col("text")) + T.chat_tokens(F.col("role"))) + 2).cast("bigint").alias("tokens"))


@query("sentences", f"SELECT doc_id, (i - 1)::BIGINT AS sent_idx, md5(s[i]) AS sent_md5, length(s[i])::BIGINT AS n_chars FROM (SELECT doc_id, {SENTS} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)")
def sentences(spark, sf_dir):
    """A row for each sentence."""
    s = docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    return s.select("doc_id", F.col("i").cast("bigint").alias("sent_idx"), F.md5("s").alias("sent_md5"), F.length("s").cast("bigint").alias("n_chars"))


@query("sentence_offsets", rf"""WITH p AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '(?s).*?(?:[.!?]\s+|$)') AS parts FROM p),
e AS (SELECT doc_id, i, parts[i] AS part, coalesce(list_sum(list_transform(parts[1:i-1], lambda x: length(x))), 0)::BIGINT AS start_at FROM s, unnest(range(1, len(parts) + 1)) AS u(i))
SELECT doc_id, start_at, (start_at + length(regexp_replace(part, '\s+$', '')))::BIGINT AS end_at FROM e WHERE regexp_replace(part, '\s+', '', 'g') <> ''""")
def sentence_offsets(spark, sf_dir):
    """Start and end of each sentence in its trimmed page; a running sum of what precedes it."""
    s = docs(spark, sf_dir).select("doc_id", F.split(T.strip(F.col("text")), r"(?<=[.!?])(?=\s)").alias("parts"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("s")))).alias("out"))
    placed = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,s:string>>").alias("out")), step)["out"]
    e = s.select("doc_id", F.explode(placed).alias("p")).where(T.strip(F.col("p.s")) != "")
    lead = F.length("p.s") - F.length(F.regexp_replace("p.s", r"^\s+", ""))
    return e.select("doc_id", (F.col("p.at") + lead).cast("bigint").alias("start_at"), (F.col("p.at") + F.length("p.s")).cast("bigint").alias("end_at"))


_IN = lambda known: " + ".join(f"contains(lower(text), ' {w} ')::INT" for w in known)


@query("lang_detect", f"SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 50 THEN 'unknown' WHEN ({_IN(T.GERMAN)}) > ({_IN(T.ENGLISH)}) THEN 'de' WHEN ({_IN(T.ENGLISH)}) > ({_IN(T.GERMAN)}) THEN 'en' ELSE 'unknown' END AS detected FROM documents")
def lang_detect(spark, sf_dir):
    """German or English by telling words."""
    return docs(spark, sf_dir).select("doc_id", T.language(F.col("text")).alias("detected"))


@query("clean_text", r"""SELECT doc_id, md5(c) AS clean_md5, length(c)::BIGINT AS n_chars FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([.!?])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)""")
def clean_text(spark, sf_dir):
    """Cleaned texts."""
    return docs(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("c")).select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").cast("bigint").alias("n_chars"))


@query("text_validity", r"""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) >= 10 AS meaningful, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10 AND length(regexp_replace(text, '[\p{C}\p{Zl}\p{Zp}\x{A0}]', '', 'g')) >= 0.7 * length(text) AS extracted_ok, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10 AS guard_ok FROM documents""")
def text_validity(spark, sf_dir):
    """The three checks that extracted text passes."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.meaningful(t).alias("meaningful"), T.extracted_ok(t).alias("extracted_ok"), (F.length(T.strip(t)) >= 10).alias("guard_ok"))


@query("text_keys", r"""SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))) AS same_key, md5(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}_\s.,!?%-]', ' ', 'g'), '\s+', ' ', 'g')) AS normal_md5, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview, left(translate(lower(source || '_My Space'), ' _', '--'), 50) AS namespace FROM documents""")
def text_keys(spark, sf_dir):
    """Sentence key, advanced normal form, preview and namespace."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(T.same_key(t)).alias("same_key"), F.md5(T.normalise(t)).alias("normal_md5"), T.preview(t, 200).alias("preview"), T.slug(F.concat("source", F.lit("_My Space"))).alias("namespace"))


@query("text_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(lower(text)) AS seed FROM documents")
def text_hashes(spark, sf_dir):
    """File hash, cache key and seed."""
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.sha1(F.lower("text")).alias("seed"))


@query("content_types", """SELECT p_partkey, CASE WHEN n IN ('legal_text','technical','technical_spec','table_heavy','table','list','narrative','mixed','unknown') THEN n WHEN contains(n, 'table') THEN CASE WHEN contains(n, 'heavy') THEN 'table_heavy' ELSE 'table' END WHEN contains(n, 'tech') THEN CASE WHEN contains(n, 'spec') THEN 'technical_spec' ELSE 'technical' END WHEN contains(n, 'legal') THEN 'legal_text' WHEN contains(n, 'narr') THEN 'narrative' WHEN contains(n, 'list') THEN 'list' ELSE 'mixed' END AS content_type
FROM (SELECT p_partkey, lower(['LEGAL_text','big table','heavy table','tech doc','Tech spec','legally','narration','lists','else','list'][(p_partkey % 10 + 1)::INT]) AS n FROM part)""")
def content_types(spark, sf_dir):
    """Content types of names."""
    names = F.array(*map(F.lit, ["LEGAL_text", "big table", "heavy table", "tech doc", "Tech spec", "legally", "narration", "lists", "else", "list"]))
    return table(spark, sf_dir, "part").select("p_partkey", T.content_type(F.get(names, (F.col("p_partkey") % 10).cast("int"))).alias("content_type"))


@query("section_numbers", """SELECT s_suppkey, CASE WHEN list_contains(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'], upper(b)) THEN list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'], upper(b))::VARCHAR ELSE b END AS section
FROM (SELECT s_suppkey, regexp_replace(['III.','1.2.','iv','XVI','2.1.3','','xv..','C'][(s_suppkey % 8 + 1)::INT], '\\.+$', '') AS b FROM supplier)""")
def section_numbers(spark, sf_dir):
    """Section numbers in one form."""
    names = F.array(*map(F.lit, ["III.", "1.2.", "iv", "XVI", "2.1.3", "", "xv..", "C"]))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.section_number(F.get(names, (F.col("s_suppkey") % 8).cast("int"))).alias("section"))


@query("section_context", r"""WITH b AS (SELECT doc_id, text, greatest(0, length(text) // 2 - 200) AS st, least(length(text), length(text) // 2 + 200) AS en FROM documents),
c AS (SELECT *, text[st+1:en] AS part FROM b),
d AS (SELECT *, CASE WHEN st > 0 AND NOT regexp_matches(text[st+1], '\s') AND contains(part, ' ') THEN regexp_replace(part, '^[^ ]* ', '') ELSE part END AS p2 FROM c)
SELECT doc_id, regexp_replace(CASE WHEN en < length(text) AND NOT regexp_matches(text[en], '\s') AND contains(p2, ' ') THEN regexp_replace(p2, ' [^ ]*$', '') ELSE p2 END, '^\s+|\s+$', '', 'g') AS context FROM d""")
def section_context(spark, sf_dir):
    """Text around the middle of each document."""
    return docs(spark, sf_dir).select("doc_id", T.around(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("context"))


@query("prompts", r"""SELECT b.item_id, 'Context:' || chr(10) || b.text || chr(10) || chr(10) || 'Question: explain ' || left(b.text, 30) AS prompt, 'Section: ' || b.item_id || '. Content: ' || b.text AS contextual FROM benchmark b""")
def prompts(spark, sf_dir):
    """Prompt and contextual embedding text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.format_string("Context:\n%s\n\nQuestion: explain %s", "text", F.left("text", F.lit(30))).alias("prompt"), F.concat(F.lit("Section: "), F.col("item_id").cast("string"), F.lit(". Content: "), "text").alias("contextual"))


@query("headings", r"""WITH n AS (SELECT r_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT r_regionkey, 0 AS k, upper(r_name) AS line FROM region UNION ALL SELECT r_regionkey, 2 * i - 1, '1.' || i || ' About ' || n_name FROM n UNION ALL SELECT r_regionkey, 2 * i, 'Some words of plain text, no. ' || n_nationkey FROM n),
o AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY r_regionkey ORDER BY k) - length(line) - 1)::BIGINT AS pos0 FROM l)
SELECT r_regionkey::BIGINT AS page, pos0 AS head_offset, CASE WHEN k = 0 THEN '' ELSE split_part(line, ' ', 1) END AS number, CASE WHEN k = 0 THEN (SELECT string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ') FROM unnest(string_split(line, ' ')) AS u(w)) ELSE substr(line, strpos(line, ' ') + 1) END AS title,
CASE WHEN k = 0 THEN (SELECT string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ') FROM unnest(string_split(line, ' ')) AS u(w)) ELSE (SELECT string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ') FROM unnest(string_split((SELECT upper(r_name) FROM region r WHERE r.r_regionkey = o.r_regionkey), ' ')) AS u(w)) || ' > ' || substr(line, strpos(line, ' ') + 1) END AS path
FROM o WHERE k = 0 OR k % 2 = 1""")
def headings(spark, sf_dir):
    """Headings of pages made of regions and nations, with their paths."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    lines = F.flatten(F.transform("ns", lambda x, i: F.array(F.concat(F.lit("1."), (i + 1).cast("string"), F.lit(" About "), x["n_name"]), F.concat(F.lit("Some words of plain text, no. "), x["n_nationkey"].cast("string")))))
    page = F.concat_ws("\n", F.concat(F.array(F.upper("r_name")), lines))
    pages = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").cast("bigint").alias("page"), T.hierarchy(T.headings(page)).alias("h"))
    h = pages.select("page", F.explode("h").alias("h"))
    return h.select("page", F.col("h.offset").cast("bigint").alias("head_offset"), "h.number", "h.title", F.array_join("h.path", " > ").alias("path"))


@query("heading_asof", r"""WITH h AS (SELECT o_custkey AS page, o_orderkey AS at, 'S' || o_orderkey AS title FROM orders WHERE o_orderkey % 4 = 0), s AS (SELECT o_custkey AS page, o_orderkey AS pos FROM orders)
SELECT s.page, s.pos, coalesce(h.title, '') AS section FROM s ASOF LEFT JOIN h ON s.page = h.page AND s.pos >= h.at""")
def heading_asof(spark, sf_dir):
    """Nearest preceding heading of each offset: one sort by page and offset, no range join."""
    from spindrift.operators.joins import as_of

    o = table(spark, sf_dir, "orders")
    heads = o.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("section"))
    found = as_of(o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("pos")), heads, ["page"], "pos", ["section"])
    return found.select("page", "pos", F.coalesce("section", F.lit("")).alias("section"))
