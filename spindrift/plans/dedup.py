"""Queries of deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import dedup as D
from spindrift.plans.registry import query
from spindrift.session import documents

_W = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
_HALF = "sum(CASE WHEN (({h} >> {i}) & 1) = 1 THEN 1 ELSE -1 END) >= 0"
_BITS = lambda h: " + ".join(f"(CASE WHEN {_HALF.format(h=h, i=i)} THEN {1 << i} ELSE 0 END)" for i in range(32))
SIM = f"""w AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT doc_id, md5(array_to_string(w[i:i+2], ' ')) AS h FROM w, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
b AS (SELECT doc_id, ('0x' || left(h, 8))::BIGINT AS hi, ('0x' || substr(h, 9, 8))::BIGINT AS lo FROM g), sim AS (SELECT doc_id, ({_BITS('hi')})::BIGINT AS hi, ({_BITS('lo')})::BIGINT AS lo FROM b GROUP BY doc_id)"""


def hashes(spark, sf_dir):
    return D.ngram_simhash(documents(spark, sf_dir), "doc_id", F.col("text"))


@query("simhash", f"WITH {SIM} SELECT doc_id, printf('%08x%08x', hi, lo) AS simhash FROM sim")
def simhash(spark, sf_dir):
    """SimHash of each document over word 3-grams; documents without one have none."""
    return hashes(spark, sf_dir).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


_NEAR = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"


@query("near_dups", f"WITH {SIM}, c AS (SELECT min(doc_id) AS id, hi, lo FROM sim GROUP BY hi, lo) SELECT a.id AS a, b.id AS b, ({_NEAR})::BIGINT AS distance FROM c a JOIN c b ON a.id < b.id AND {_NEAR} <= 8 UNION ALL SELECT c.id, s.doc_id, 0 FROM c JOIN sim s ON s.hi = c.hi AND s.lo = c.lo AND s.doc_id > c.id")
def near_dups(spark, sf_dir):
    """Pairs of different hashes at most eight bits apart, each hash by its smallest document, and each further document of a hash at distance 0."""
    return D.near_links(hashes(spark, sf_dir), "doc_id", 8)


_D = lambda p: f"len(regexp_extract_all(text, '{p}')) / n"


@query("semantic_features", rf"WITH w AS (SELECT doc_id, text, {_W} AS w, len({_W})::DOUBLE AS n FROM documents) SELECT doc_id, n::BIGINT AS word_count, round(len(list_distinct(w)) / n, 6) AS diversity, greatest(1, len(regexp_extract_all(text, '[.!?]')))::BIGINT AS sentence_count, round({_D(D.PATTERNS['numbers'][0])}, 6) AS numbers_density, round(len(list_distinct(w)) / n * 0.3 + {_D(D.PATTERNS['legal_terms'][0])} * 0.4 + {_D(D.PATTERNS['insurance_benefits'][0])} * 0.3, 6) AS complexity FROM w")
def semantic_features(spark, sf_dir):
    """Features of each document."""
    f = D.features(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", f["word_count"].cast("bigint").alias("word_count"), F.round(f["lexical_diversity"], 6).alias("diversity"), f["sentence_count"].cast("bigint").alias("sentence_count"), F.round(f["numbers_density"], 6).alias("numbers_density"), F.round(f["semantic_complexity"], 6).alias("complexity"))


@query("ngram_terms", r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}_\s.,!?%-]', ' ', 'g'), '\s+', ' ', 'g') AS bare FROM documents),
w AS (SELECT doc_id, bare, list_filter(regexp_split_to_array(bare, '\s+'), lambda x: length(x) >= 3 AND x NOT IN ('the','a','an','and','or','but','in','on','at','to','for','of','with','by','is','are','was','were','be','been','have','has','had','do','does','did','will','would','could','should')) AS w FROM t),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [left(bare, 20)] WHEN len(w) < 3 THEN w ELSE list_concat(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')), list_filter(w, lambda x: length(x) >= 6 OR regexp_matches(x, '(?i)\b(rechtsschutz|versicherung|klausel|bedingung|haftung|leistung|erstattung|zahlung|deckung|schutz|arzt|behandlung|krankenhaus|medizin|therapie|ausschluss|nicht|kein|ohne|ausgenommen)\b|\d+'))) END AS g FROM w)
SELECT doc_id, len(list_distinct(g))::BIGINT AS terms, md5(array_to_string(list_sort(list_transform(list_distinct(g), lambda x: md5(x))), ',')) AS digest FROM g""")
def ngram_terms(spark, sf_dir):
    """Weighted-hash terms of documents, as a digest of the set."""
    g = documents(spark, sf_dir).select("doc_id", D.weighted_terms(F.col("text")).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("terms"), F.md5(F.array_join(F.sort_array(F.transform("g", lambda x: F.md5(x))), ",")).alias("digest"))


@query("weighted_simhash")
def weighted_simhash(spark, sf_dir):
    """SimHash with idf and pattern weights; a bit needs more votes for than against."""
    found = D.idf_simhash(documents(spark, sf_dir), "doc_id", F.col("text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


@query("dedup_clusters")
def dedup_clusters(spark, sf_dir):
    """Clusters of near-duplicates by combined similarity, each with its representative."""
    d = documents(spark, sf_dir)
    roots = D.clusters(hashes(spark, sf_dir), d, "doc_id")
    kinds = F.get(F.array(*map(F.lit, ["legal_text", "table", "narrative"])), (F.col("doc_id") % 3).cast("int"))
    roots = roots.checkpoint()
    scored = D.picked(d.withColumn("id", F.col("doc_id")), roots).select("id", F.round(D.representative_score(F.col("text"), F.col("doc_id") % 7, kinds), 6).alias("score"))
    best = roots.join(scored, "id").groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max_by("id", F.struct("score", -F.col("id"))).alias("representative"))
    return best.select("root", "members", "representative")


@query("dedup_rate", f"WITH {SIM}, p AS (SELECT DISTINCT b.doc_id FROM sim a JOIN sim b ON a.doc_id < b.doc_id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8) SELECT (SELECT count(*) FROM documents) AS original, (SELECT count(*) FROM p) AS removed, round((SELECT count(*) FROM p) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS rate")
def dedup_rate(spark, sf_dir):
    """How many documents have an earlier near-duplicate."""
    d = documents(spark, sf_dir).select("doc_id")
    gone = D.followers(hashes(spark, sf_dir), "doc_id", 8).select(F.col("id").alias("doc_id"), F.lit(1).alias("gone"))
    return d.join(gone, "doc_id", "left").agg(F.count(F.lit(1)).alias("original"), F.count("gone").alias("removed"), F.round(F.count("gone") / F.count(F.lit(1)), 6).alias("rate"))
