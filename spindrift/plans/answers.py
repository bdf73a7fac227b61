"""Queries of query understanding, classification, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spindrift.functions import rules
from spindrift.operators import answers as A
from spindrift.operators import retrieval as R
from spindrift.operators.joins import containing
from spindrift.plans.registry import query
from spindrift.plans.retrieval import HITS, asked, chunks, hits
from spindrift.plans.store import last_user_turn
from spindrift.session import table

_S = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LIST = lambda ws: "[" + ",".join(f"'{w}'" for w in ws) + "]"
REWRITE = rf"""lu AS (SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id), ba AS (SELECT conv_id, {_S.format(r"regexp_replace(" + _S.format('text') + r", '(?i)^(hi|hello|hey)[,!\s]*', '')")} AS bare FROM lu),
cl AS (SELECT conv_id, coalesce(list_filter(list_transform(regexp_split_to_array(bare, '[.?!;\n]+'), lambda c: {_S.format('c')}), lambda c: c <> '')[-1], bare) AS last FROM ba),
tk AS (SELECT conv_id, last, list_filter(list_transform(regexp_extract_all(last, '[A-Za-zÀ-ÖØ-öø-ÿ0-9\-]+'), lambda w: lower(w)), lambda w: NOT list_contains({_LIST(rules.STOP)}, w) AND length(w) > 1) AS ts FROM cl),
dq AS (SELECT conv_id, last, list_filter(ts, lambda w, i: list_position(ts, w) = i) AS ts FROM tk), rw AS (SELECT conv_id, CASE WHEN len(ts) > 0 THEN array_to_string(ts[1:24], ' ') ELSE left(last, 200) END AS focused FROM dq)"""


@query("rewrite", f"WITH {REWRITE} SELECT * FROM rw")
def rewrite(spark, sf_dir):
    """Focused query of each conversation."""
    return last_user_turn(spark, sf_dir).select("conv_id", rules.rewrite(F.col("text")).alias("focused"))


@query("query_plan", f"WITH {REWRITE} SELECT conv_id, left(regexp_replace({_S.format('focused')}, '\\s+', ' ', 'g'), 200) AS focused, 'explain ' || {_S.format('focused')} AS first_expansion, 'overview of ' || {_S.format('focused')} AS second_expansion, 3::BIGINT AS queries FROM rw")
def query_plan(spark, sf_dir):
    """Focused query and its expansions."""
    q = rewrite(spark, sf_dir)
    e = rules.expand(F.col("focused"), 2)
    return q.select("conv_id", F.left(F.regexp_replace(F.trim("focused"), r"\s+", " "), F.lit(200)).alias("focused"), F.get(e, F.lit(0)).alias("first_expansion"), F.get(e, F.lit(1)).alias("second_expansion"), (F.size(e) + 1).cast("bigint").alias("queries"))


@query("expand_synonyms", "SELECT p_partkey, ['explain ' || q, 'overview of ' || q, 'coverage for a ' || w, 'policy for a ' || w][(i)::INT] AS expansion, i FROM (SELECT p_partkey, 'insurance for a ' || lower(split_part(p_type, ' ', 1)) AS q, lower(split_part(p_type, ' ', 1)) AS w FROM part), (VALUES (1::BIGINT), (2), (3), (4)) AS v(i)")
def expand_synonyms(spark, sf_dir):
    """Four expansions, with synonyms."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("insurance for a "), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("q"))
    return p.select("p_partkey", F.posexplode(rules.expand(F.col("q"), 4)).alias("k", "expansion")).select("p_partkey", (F.col("k") + 1).cast("bigint").alias("i"), "expansion")


#: User texts with words of all intents.
SAID = "said AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Was ist das? Beratung und Hilfe, bitte' WHEN 1 THEN 'Ich möchte Versicherung beantragen: Antrag, Vertrag' WHEN 2 THEN 'Risiko, Vorerkrankung und Gesundheit im Beruf' WHEN 3 THEN 'Wetter und Sport' WHEN 4 THEN 'nothing known' WHEN 5 THEN 'Ich arbeite als Pilot bei ' || user_id || ' am 01.02.1990' WHEN 6 THEN 'Mein Beruf: als Koch' WHEN 7 THEN 'Gehalt 54000.50 Euro' ELSE 'Antrag antrag stellen, vertragsabschluss, abschließen, police, anmeldung, beantragen' END AS text FROM events)"


def said(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    texts = ["Was ist das? Beratung und Hilfe, bitte", "Ich möchte Versicherung beantragen: Antrag, Vertrag", "Risiko, Vorerkrankung und Gesundheit im Beruf", "Wetter und Sport", "nothing known", None, "Mein Beruf: als Koch", "Gehalt 54000.50 Euro", "Antrag antrag stellen, vertragsabschluss, abschließen, police, anmeldung, beantragen"]
    own = F.concat(F.lit("Ich arbeite als Pilot bei "), F.col("user_id").cast("string"), F.lit(" am 01.02.1990"))
    return e.select("event_id", "user_id", "ts", F.coalesce(F.get(F.array(*(F.lit(t) for t in texts)), (F.col("event_id") % 9).cast("int")), own).alias("text"))


_HITS_OF = lambda k: f"len(list_filter({_LIST(rules.INTENTS[k])}, lambda w: contains(lower(text), w))) / {len(rules.INTENTS[k])}.0"
_SCORES = ", ".join(f"(round({_HITS_OF(k)}, 12)::DOUBLE, {-i}, '{k}')" for i, k in enumerate(rules.INTENTS))


@query("intent", f"WITH {SAID}, s AS (SELECT event_id, list_max([{_SCORES}]) AS b FROM said), c AS (SELECT event_id, CASE WHEN b[1] > 0 THEN b[3] ELSE 'advice' END AS intent, CASE WHEN b[1] > 0 THEN least(b[1] * 2, 0.9) ELSE 0.1 END AS confidence FROM s) SELECT event_id, intent, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN confidence < 0.3 THEN 'advice' ELSE intent END AS routed FROM c")
def intent(spark, sf_dir):
    """Intent, its confidence and the route at a threshold of 0.3."""
    found = said(spark, sf_dir).select("event_id", rules.intent(F.col("text")).alias("x"))
    return found.select("event_id", "x.intent", F.round("x.confidence", 6).alias("confidence"), rules.route(F.col("x"), 0.3).alias("routed"))


@query("field_extraction", rf"WITH {SAID}, w AS (SELECT event_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM said), p AS (SELECT *, list_position(list_transform(ws, lambda x: lower(x)), 'als') AS k FROM w) SELECT event_id, nullif(regexp_extract(text, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}'), '') AS geburtsdatum, CASE WHEN (contains(lower(text), 'beruf') OR contains(lower(text), 'arbeite als')) AND k > 0 AND k < len(ws) THEN array_to_string(ws[k+1:k+2], ' ') END AS beruf, nullif(regexp_extract(text, '\d+\.?\d*'), '') AS jahreseinkommen FROM p")
def field_extraction(spark, sf_dir):
    """Fields of an application that a text gives."""
    f = rules.fields(F.col("text"), "application")
    return said(spark, sf_dir).select("event_id", *(f[k].alias(k) for k in ("geburtsdatum", "beruf", "jahreseinkommen")))


@query("requirements", rf"""WITH {SAID.replace('SELECT event_id,', 'SELECT event_id, user_id, ts,')}, w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM said), p AS (SELECT *, list_position(list_transform(ws, lambda x: lower(x)), 'als') AS k FROM w), f AS (SELECT user_id, ts, event_id, nullif(regexp_extract(text, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}'), '') AS d, CASE WHEN (contains(lower(text), 'beruf') OR contains(lower(text), 'arbeite als')) AND k > 0 AND k < len(ws) THEN array_to_string(ws[k+1:k+2], ' ') END AS j, nullif(regexp_extract(text, '\d+\.?\d*'), '') AS n FROM p WHERE event_id % 9 <> 5 OR user_id % 2 = 0),
g AS (SELECT user_id, max_by(d, (ts, event_id)) FILTER (WHERE d IS NOT NULL) AS d, max_by(j, (ts, event_id)) FILTER (WHERE j IS NOT NULL) AS j, max_by(n, (ts, event_id)) FILTER (WHERE n IS NOT NULL) AS n FROM f GROUP BY user_id) SELECT user_id, d AS geburtsdatum, j AS beruf, n AS jahreseinkommen, CASE WHEN d IS NULL THEN 'Bitte nennen Sie Ihr Geburtsdatum (TT.MM.JJJJ):' WHEN j IS NULL THEN 'Welchen Beruf üben Sie aktuell aus?' WHEN n IS NULL THEN 'Wie hoch ist Ihr jährliches Bruttoeinkommen?' END AS next_question FROM g""")
def requirements(spark, sf_dir):
    """What each user gave so far, the latest of each field, and the next question in the declared order."""
    s = said(spark, sf_dir).where("event_id % 9 <> 5 or user_id % 2 = 0")
    names = ("geburtsdatum", "beruf", "jahreseinkommen")
    f = rules.fields(F.col("text"), "application")
    rows = s.select("user_id", F.struct("ts", "event_id").alias("o"), *(f[k].alias(k) for k in names))
    got = rows.groupBy("user_id").agg(*(F.max_by(k, F.when(F.col(k).isNotNull(), F.col("o"))).alias(k) for k in names))
    ask = F.coalesce(*(F.when(F.col(k).isNull(), rules.QUESTIONS["application"][k]) for k in names))
    return got.select("user_id", *names, ask.alias("next_question"))


@query("risk", "SELECT c_custkey, p AS points, CASE WHEN p < 3 THEN 'low' WHEN p < 6 THEN 'medium' ELSE 'high' END AS level FROM (SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END)::BIGINT AS p FROM customer)")
def risk(spark, sf_dir):
    """Risk points and level."""
    say = lambda n, yes: F.when(F.col("c_custkey") % n == 0, yes).otherwise("keine")
    points = rules.risk(say(3, "Ich bin Pilotin"), say(4, "Herzfehler"), say(5, "Skifahren")).cast("bigint")
    return table(spark, sf_dir, "customer").select("c_custkey", points.alias("points"), F.when(points < 3, "low").when(points < 6, "medium").otherwise("high").alias("level"))


@query("softmax", "WITH x AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: v::DOUBLE * 10) AS l FROM embeddings), e AS (SELECT vec_id, l, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM x), p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e) SELECT vec_id, (list_position(p, list_max(p)) - 1)::BIGINT AS category, round(list_max(p), 6) AS confidence, list_max(p) >= 0.8 AS is_confident FROM p")
def softmax(spark, sf_dir):
    """Category, confidence and whether it is confident, from eight logits."""
    logits = F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double") * 10)
    p = table(spark, sf_dir, "embeddings").select("vec_id", rules.softmax(logits).alias("p"))
    top = F.array_max("p")
    return p.select("vec_id", (F.array_position("p", top) - 1).alias("category"), F.round(top, 6).alias("confidence"), (top >= 0.8).alias("is_confident"))


_VOTE = "v AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS category, round(l_discount * 100)::BIGINT AS confidence, 4 + l_linenumber % 3 AS importance, l_linenumber % 5 = 0 AS failed FROM lineitem)"


@query("chunk_voting", f"WITH {_VOTE}, c AS (SELECT doc, category, sum(confidence * importance)::BIGINT AS votes FROM v WHERE NOT failed GROUP BY doc, category), w AS (SELECT doc, max_by(category, (votes, -category)) AS category, max(votes)::DOUBLE AS best, sum(votes)::DOUBLE AS total FROM c GROUP BY doc), s AS (SELECT doc, count(*) AS chunks, count(*) FILTER (WHERE NOT failed) AS processed, round(avg(confidence) FILTER (WHERE NOT failed), 6) AS mean, count(*) FILTER (WHERE NOT failed AND confidence > 8) AS confident FROM v GROUP BY doc) SELECT s.doc, coalesce(w.category, 0)::BIGINT AS category, round(CASE WHEN total > 0 THEN best / total ELSE 0 END, 6)::DOUBLE AS share, chunks, processed, coalesce(mean, 0)::DOUBLE AS mean_confidence, confident FROM s LEFT JOIN w ON s.doc = w.doc")
def chunk_voting(spark, sf_dir):
    """Category of each document by its chunks' weighted votes: confidences in hundredths, importance in quarters."""
    li = table(spark, sf_dir, "lineitem")
    v = li.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 3).alias("category"), F.round(F.col("l_discount") * 100).cast("bigint").alias("confidence"), (4 + F.col("l_linenumber") % 3).alias("importance"), (F.col("l_linenumber") % 5 == 0).alias("failed"))
    ok = ~F.col("failed")
    per = v.groupBy("doc", "category").agg(F.sum(F.when(ok, F.col("confidence") * F.col("importance"))).alias("votes"), F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("done"), F.sum(F.when(ok, F.col("confidence"))).alias("c"), F.count_if(ok & (F.col("confidence") > 8)).alias("sure"))
    g = per.groupBy("doc").agg(F.max_by("category", F.when(F.col("done") > 0, F.struct("votes", -F.col("category")))).alias("category"), F.max("votes").alias("best"), F.sum("votes").alias("total"), F.sum("n").alias("chunks"), F.sum("done").alias("processed"), F.sum("c").alias("c"), F.sum("sure").alias("confident"))
    share = F.coalesce(F.when(F.col("total") > 0, F.col("best") / F.col("total")), F.lit(0.0))
    mean = F.coalesce(F.when(F.col("processed") > 0, F.col("c") / F.col("processed")), F.lit(0.0))
    return g.select("doc", F.coalesce("category", F.lit(0)).cast("bigint").alias("category"), F.round(share, 6).alias("share"), "chunks", "processed", F.round(mean, 6).alias("mean_confidence"), "confident")


@query("hybrid_threshold", "WITH p AS (SELECT d.doc_id, l.quality AS truth, d.doc_id % 2 AS ml, (d.doc_id * 7 % 100) / 100.0 AS conf, (d.doc_id // 3) % 2 AS rule FROM documents d JOIN labels l ON l.doc_id = d.doc_id), t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS t) SELECT t::DOUBLE AS threshold, round(avg((CASE WHEN conf >= t THEN ml ELSE rule END = truth)::INT), 6) AS accuracy, count(*) FILTER (WHERE conf >= t) AS by_model FROM p, t GROUP BY t")
def hybrid_threshold(spark, sf_dir):
    """Accuracy of taking the model above a threshold and the rule below, for five thresholds in one pass."""
    p = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id")
    p = p.select("truth", (F.col("doc_id") % 2).alias("ml"), (F.col("doc_id") * 7 % 100 / 100.0).alias("conf"), (F.floor(F.col("doc_id") / 3) % 2).alias("rule"), F.explode(F.array(*map(F.lit, (0.5, 0.6, 0.7, 0.8, 0.9)))).alias("threshold"))
    by_model = F.col("conf") >= F.col("threshold")
    right = F.when(by_model, F.col("ml")).otherwise(F.col("rule")) == F.col("truth")
    return p.groupBy("threshold").agg(F.round(F.avg(right.cast("int")), 6).alias("accuracy"), F.count_if(by_model).alias("by_model"))


_RANK = "ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits)"


def ranked(spark, sf_dir):
    return R.top(hits(spark, sf_dir), 2**31 - 1)


@query("quotas", f"WITH {HITS}, m AS (SELECT qid, id, pow((score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1e-6 ELSE max(score) OVER w - min(score) OVER w END, 0.7) AS p FROM hits WINDOW w AS (PARTITION BY qid)) SELECT qid, id, round(p / CASE WHEN sum(p) OVER (PARTITION BY qid) = 0 THEN 1 ELSE sum(p) OVER (PARTITION BY qid) END, 6) AS quota FROM m")
def quotas(spark, sf_dir):
    """Shares of the context budget."""
    return A.quotas(hits(spark, sf_dir)).select("qid", "id", F.round("quota", 6).alias("quota"))


@query("context_pack")
def context_pack(spark, sf_dir):
    """Packed and numbered context blocks."""
    return A.pack(A.quotas(ranked(spark, sf_dir)), 300)


@query("confidence", f"WITH {HITS}, {_RANK} SELECT qid, round(avg(least(1.0, greatest(0.0, score))), 6) AS confidence FROM ranked WHERE rank <= 5 GROUP BY qid")
def confidence(spark, sf_dir):
    """Mean of the five best scores."""
    return A.confidence(ranked(spark, sf_dir)).select("qid", F.round("confidence", 6).alias("confidence"))


@query("numeric_conflict")
def numeric_conflict(spark, sf_dir):
    """Whether the best hits contradict each other in numbers."""
    d = table(spark, sf_dir, "documents")
    h = d.select((F.col("doc_id") % 10).alias("qid"), F.col("doc_id").alias("id"), (F.col("doc_id") * 37 % 100 / 100.0).alias("score"), "text")
    return A.numeric_conflict(R.top(h, 5))


_NEG, _UNS = r"regexp_matches(lower(text), '\b(not|no|never|unlikely|false)\b')", r"regexp_matches(lower(text), '\b(might|may|possibly|uncertain|unknown)\b')"


@query("grounding", f"WITH h AS (SELECT doc_id % 50 AS qid, doc_id % 3 AS doc_id, (doc_id * 37 % 100) / 100.0 AS score, CASE doc_id % 4 WHEN 0 THEN text || ' not' WHEN 1 THEN text || ' may be' ELSE text END AS text FROM documents), g AS (SELECT qid, round(avg(score), 9) AS mean, count(DISTINCT doc_id) AS docs, count(*) AS n, count(*) FILTER (WHERE {_NEG}) AS no, count(*) FILTER (WHERE {_UNS}) AS un FROM h GROUP BY qid), r AS (SELECT *, CASE WHEN mean < 0.3 THEN 'low confidence' WHEN docs < 2 THEN 'few sources' ELSE 'sufficient' END AS reason FROM g) SELECT qid, reason = 'sufficient' AS sufficient, reason, CASE WHEN reason = 'sufficient' THEN concat_ws(',', CASE WHEN no > 0 AND no < n THEN 'conflict' END, CASE WHEN un > n * 0.6 THEN 'uncertain' END) ELSE '' END AS warnings FROM r")
def grounding(spark, sf_dir):
    """Whether the hits of a query support an answer."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" not"))).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" may be"))).otherwise(F.col("text"))
    return A.grounding(d.select((F.col("doc_id") % 50).alias("qid"), (F.col("doc_id") % 3).alias("doc_id"), (F.col("doc_id") * 37 % 100 / F.lit(100.0)).alias("score"), text.alias("text")))


def answered(spark, sf_dir):
    packed = A.pack(A.quotas(ranked(spark, sf_dir)), 300)
    return packed, A.answer(packed)


@query("answers")
def answers(spark, sf_dir):
    """Cited answers where the hits are confident and do not conflict, refusals elsewhere."""
    h = ranked(spark, sf_dir)
    gate = A.confidence(h).join(A.numeric_conflict(h), "qid").join(A.grounding(h), "qid")
    ok = (F.round("confidence", 9) >= 0.25) & ~F.col("conflict") & F.col("sufficient")
    return gate.join(answered(spark, sf_dir)[1], "qid", "left").select("qid", ok.alias("answered"), F.when(ok & F.col("answer").isNotNull(), F.col("answer")).otherwise(A.REFUSAL).alias("answer"), F.coalesce("sources", F.lit(0)).alias("sources"))


@query("citations", r"WITH p AS (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' [1]' WHEN 1 THEN ' [1, 2]' WHEN 2 THEN ' [7]' ELSE '' END AS p FROM benchmark), c AS (SELECT item_id, regexp_extract(p, '\[(\d+(?:\s*,\s*\d+)*)\]$', 1) AS c FROM p) SELECT item_id, c <> '' AND list_bool_and(list_transform(string_split(c, ','), lambda x: coalesce(try_cast(trim(x) AS INT) BETWEEN 1 AND 3, false))) AS valid FROM c")
def citations(spark, sf_dir):
    """Paragraphs that cite existing sources of three."""
    p = F.concat("text", F.get(F.array(F.lit(" [1]"), F.lit(" [1, 2]"), F.lit(" [7]"), F.lit("")), (F.col("item_id") % 4).cast("int")))
    return table(spark, sf_dir, "benchmark").select("item_id", rules.citation_ok(p, F.lit(3)).alias("valid"))


@query("citation_accuracy", r"WITH p AS (SELECT item_id % 5 AS answer, text || CASE item_id % 4 WHEN 0 THEN ' [1]' WHEN 1 THEN ' [1, 2]' WHEN 2 THEN ' [7]' ELSE '' END AS p FROM benchmark), c AS (SELECT answer, regexp_extract(p, '\[(\d+(?:\s*,\s*\d+)*)\]$', 1) AS c FROM p) SELECT answer, round(avg((c <> '' AND list_bool_and(list_transform(string_split(c, ','), lambda x: coalesce(try_cast(trim(x) AS INT) BETWEEN 1 AND 3, false))))::INT), 6) AS accuracy FROM c GROUP BY answer")
def citation_accuracy(spark, sf_dir):
    """Share of an answer's paragraphs that cite existing sources."""
    p = F.concat("text", F.get(F.array(F.lit(" [1]"), F.lit(" [1, 2]"), F.lit(" [7]"), F.lit("")), (F.col("item_id") % 4).cast("int")))
    return table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 5).alias("answer")).agg(F.round(F.avg(rules.citation_ok(p, F.lit(3)).cast("int")), 6).alias("accuracy"))


@query("faithfulness", "SELECT b.item_id, CASE WHEN a AND c THEN 1.0 WHEN a OR c THEN 0.5 ELSE 0.0 END::DOUBLE AS faithfulness FROM (SELECT b.item_id, contains(lower(b.text), 'tion') OR contains(lower(b.text), 'schein') AS a, contains(lower(d.text), 'tion') OR contains(lower(d.text), 'schein') AS c FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3) b")
def faithfulness(spark, sf_dir):
    """Whether keywords stand in the answer and in what it cites."""
    keywords = ("tion", "schein")
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("cited"))
    joined = b.join(d, F.col("doc_id") == F.col("item_id") * 3)
    a, c = rules.words_in(F.lower("text"), keywords) > 0, rules.words_in(F.lower("cited"), keywords) > 0
    return joined.select("item_id", F.when(a & c, 1.0).when(a | c, 0.5).otherwise(0.0).alias("faithfulness"))


_EVAL = "gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"

#: Benchmark items that are broadcast to find their gold documents; more are joined by a shuffle.
BROADCAST_ITEMS = 20_000


@query("eval_retrieval")
def eval_retrieval(spark, sf_dir):
    """hit@1, hit@3, hit@5 and reciprocal rank of BM25 for all items that stand verbatim in documents, whatever their length and wherever they begin."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    gold = containing(d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("qid"), F.col("text").alias("item")), BROADCAST_ITEMS)
    found = R.bm25(chunks(spark, sf_dir), b.select(F.col("item_id").alias("qid"), "text"), 5)
    first = gold.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))), 6)
    return first.agg(F.count(F.lit(1)).alias("queries"), *(hit(k).alias(f"hit_{k}") for k in (1, 3, 5)), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@query("quality_gate", "SELECT metric, value, threshold, value >= threshold AS passed FROM (VALUES ('hit@3', 0.7::DOUBLE, 0.66::DOUBLE), ('mrr', 0.4, 0.5), ('citation_acc', 0.8, 0.8), ('faithfulness', 0.0, 0.66)) AS t(metric, value, threshold)")
def quality_gate(spark, sf_dir):
    """Metrics against their thresholds; a missing one is 0."""
    rows = spark.createDataFrame([("hit@3", 0.7, 0.66), ("mrr", 0.4, 0.5), ("citation_acc", 0.8, 0.8), ("faithfulness", None, 0.66)], "metric string, value double, threshold double")
    return rows.withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("passed", F.col("value") >= F.col("threshold"))


@query("clf_metrics", "WITH p AS (SELECT l.quality AS truth, CASE WHEN l.doc_id % 5 = 0 THEN 1 - l.quality ELSE l.quality END AS pred FROM labels l), k AS (SELECT unnest([0, 1]) AS k), c AS (SELECT k, count(*) FILTER (WHERE truth = k) AS support, count(*) FILTER (WHERE truth = k AND pred = k) AS tp, count(*) FILTER (WHERE pred = k) AS predicted, count(*) AS n FROM p, k GROUP BY k), r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS re FROM c) SELECT round(sum(tp) / max(n)::DOUBLE, 6) AS accuracy, round(sum(support * pr) / max(n), 6) AS precision_w, round(sum(support * re) / max(n), 6) AS recall_w, round(sum(support * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) / max(n), 6) AS f1_w FROM r")
def clf_metrics(spark, sf_dir):
    """Accuracy and weighted precision, recall and F1 from the counts of truth and prediction."""
    p = table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("pred"))
    n = p.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    each = n.select(F.explode(F.array(F.struct(F.col("truth").alias("k"), F.col("n").alias("s"), F.lit(0).alias("q")), F.struct(F.col("pred").alias("k"), F.lit(0).alias("s"), F.col("n").alias("q")))).alias("x"), (F.col("truth") == F.col("pred")).alias("same"), "n").select("x.*", "same", "n")
    k = each.groupBy("k").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.when(F.col("same") & (F.col("s") > 0), F.col("n")).otherwise(0)).alias("tp"))
    pr, re = F.when(F.col("q") > 0, F.col("tp") / F.col("q")).otherwise(0.0), F.when(F.col("s") > 0, F.col("tp") / F.col("s")).otherwise(0.0)
    f1 = F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0)
    return k.agg(F.round(F.sum("tp") / F.sum("s"), 6).alias("accuracy"), *(F.round(F.sum(F.col("s") * m) / F.sum("s"), 6).alias(name) for m, name in ((pr, "precision_w"), (re, "recall_w"), (f1, "f1_w"))))


@query("category_balance", "SELECT source AS category, count(*) AS n, count(*) < 50 AS imbalanced FROM documents GROUP BY source")
def category_balance(spark, sf_dir):
    """Documents of each category, and which are few."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("category")).agg(F.count(F.lit(1)).alias("n")).withColumn("imbalanced", F.col("n") < 50)


@query("label_encoding", "WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS idx FROM (SELECT DISTINCT lang FROM documents)) SELECT d.doc_id, l.idx AS label_idx FROM documents d JOIN l ON l.lang = d.lang")
def label_encoding(spark, sf_dir):
    """Index of each label in the sorted list of labels."""
    d = table(spark, sf_dir, "documents")
    labels = d.select("lang").distinct().withColumn("label_idx", (F.row_number().over(W.orderBy("lang")) - 1).cast("bigint"))  # one row for each label
    return d.join(F.broadcast(labels), "lang").select("doc_id", "label_idx")


@query("comparison", "WITH p AS (SELECT l.quality AS truth, d.doc_id % 2 AS ml, (d.doc_id * 7 % 100) / 100.0 AS conf, (d.doc_id // 3) % 2 AS rule FROM documents d JOIN labels l ON l.doc_id = d.doc_id), t AS (SELECT t::DOUBLE AS t, round(avg((CASE WHEN conf >= t THEN ml ELSE rule END = truth)::INT), 9) AS acc FROM p, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS t) GROUP BY t) SELECT max_by(t, (acc, -t)) AS best_threshold, round(max(acc), 6) AS best_accuracy, round(round(max(acc), 6) - (SELECT avg((rule = truth)::INT) FROM p), 6) + 0.0 AS gain FROM t")
def comparison(spark, sf_dir):
    """Best threshold and what it gains over the rule alone."""
    t = hybrid_threshold(spark, sf_dir)
    p = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    alone = p.agg(F.avg((F.floor(F.col("doc_id") / 3) % 2 == F.col("quality")).cast("int")).alias("alone")).withColumn("one", F.lit(1))
    best = t.agg(F.max_by("threshold", F.struct("accuracy", -F.col("threshold"))).alias("best_threshold"), F.max("accuracy").alias("best_accuracy")).withColumn("one", F.lit(1))
    return best.join(F.broadcast(alone), "one").select("best_threshold", "best_accuracy", (F.round(F.col("best_accuracy") - F.col("alone"), 6) + 0.0).alias("gain"))  # one row each


@query("context_truncation", r"WITH h AS (SELECT qid, id, score, text, sum(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3)) OVER (PARTITION BY qid ORDER BY score DESC, id) AS upto FROM (SELECT item_id % 4 AS qid, item_id AS id, (item_id * 37 % 100) / 100.0 AS score, text FROM benchmark)) SELECT qid, count(*) FILTER (WHERE upto <= 150) AS kept, count(*) AS hits, count(*) FILTER (WHERE upto <= 150) < count(*) AS cut FROM h GROUP BY qid")
def context_truncation(spark, sf_dir):
    """How many of the best chunks fit 200 tokens less the reserve of 50: a running sum that grows, so it stops at the first that doesn't."""
    from spindrift.functions import text as T

    upto = F.sum(T.chat_tokens(F.col("text"))).over(W.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    h = hits(spark, sf_dir).withColumn("upto", upto)
    return h.groupBy("qid").agg(F.count_if(F.col("upto") <= 150).alias("kept"), F.count(F.lit(1)).alias("hits")).withColumn("cut", F.col("kept") < F.col("hits"))
