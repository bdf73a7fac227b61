"""Context packing, grounding and rule-based answers over hits (qid, id, rank, score, text, ...)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import rules

REFUSAL = "Insufficient evidence to answer confidently."
TEMPERATURE = 0.7


def quotas(hits: DataFrame) -> DataFrame:
    """Adds each hit's share of its query's budget: min-max score to the power 0.7, by the sum. All equal: 0."""
    w = W.partitionBy("qid")
    span = F.max("score").over(w) - F.min("score").over(w)
    power = F.pow((F.col("score") - F.min("score").over(w)) / F.when(span == 0, 1e-6).otherwise(span), F.lit(TEMPERATURE))
    total = F.sum("power").over(w)
    return hits.withColumn("power", power).withColumn("quota", F.col("power") / F.when(total == 0, 1.0).otherwise(total)).drop("power")


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]


def _cost(text: str) -> int:
    return max(1, round(len(text.split()) / 1.3))


def pack(hits: DataFrame, budget: int = 1200, overlap: int = 1, least: int = 80) -> DataFrame:
    """(qid, source, id, doc_id, body, tokens): numbered blocks of each query's hits (with quota), best rank first.

    A source gives sentences that no earlier one gave, up to its share, after the last ones of the block before; packing ends when the budget is spent. Sources are
    numbered 1..n as they are used. A query has few hits, and they are packed in one call.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank").drop_duplicates("id")
        seen: set[str] = set()
        out, total, before = [], 0, []
        for x in f.itertuples():
            fresh = []
            for s in _sentences(x.text):
                key = re.sub(r"\s+", " ", s).lower()
                if len(key) >= 3 and key not in seen:
                    seen.add(key)
                    fresh.append(s)
            if not fresh:
                continue
            room, taken = max(least, int(x.quota * budget)), []
            for s in [*before, *fresh]:
                if sum(map(_cost, taken)) + _cost(s) > room:
                    break
                taken.append(s)
            if not taken:
                continue
            body = " ".join(taken)
            total += _cost(body)
            out.append((x.qid, len(out) + 1, x.id, x.doc_id, body, _cost(body)))
            before = taken[-overlap:] if overlap else []
            if total >= budget:
                break
        return pd.DataFrame(out, columns=["qid", "source", "id", "doc_id", "body", "tokens"])

    return hits.groupBy("qid").applyInPandas(run, "qid long, source long, id long, doc_id long, body string, tokens long")


def answer(packed: DataFrame, paragraphs: int = 3) -> DataFrame:
    """(qid, answer, sources): the first blocks as paragraphs, each citing its source and the next one, if there is one."""
    n = F.count(F.lit(1)).over(W.partitionBy("qid"))
    cite = F.when(F.col("source") < n, F.concat(F.lit("["), F.col("source"), F.lit(","), F.col("source") + 1, F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("source"), F.lit("]")))
    rows = packed.withColumn("n", n).where(F.col("source") <= paragraphs).select("qid", "n", "source", F.concat_ws(" ", "body", cite).alias("p"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "p"))), lambda x: x["p"]), "\n\n").alias("answer"), F.max("n").alias("sources"))


def confidence(hits: DataFrame) -> DataFrame:
    """(qid, confidence): mean of the five best scores, each cut to 0..1."""
    return hits.where("rank <= 5").groupBy("qid").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))).alias("confidence"))


def numeric_conflict(hits: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """(qid, numbers, spread, conflict): whether positive numbers in the five best hits differ by more than the tolerance."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(rules.NUMERIC), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    each = hits.where("rank <= 5").select("qid", F.explode_outer(F.array_compact(numbers)).alias("x")).groupBy("qid").agg(F.count("x").alias("numbers"), F.min("x").alias("low"), F.max("x").alias("high"))
    usable = (F.col("numbers") >= 2) & (F.col("low") > 0)
    return each.withColumn("spread", F.when(usable, (F.col("high") - F.col("low")) / F.greatest("low", F.lit(1e-8)))).select("qid", "numbers", "spread", F.coalesce(F.col("spread") > tolerance, F.lit(False)).alias("conflict"))


def grounding(hits: DataFrame, least: float = 0.3, sources: int = 2) -> DataFrame:
    """(qid, sufficient, reason, warnings): mean score, number of documents, negations in some sources only, and uncertain words."""
    low = F.lower("text")
    negated, unsure = F.rlike(low, F.lit(rules.NEGATION)), F.rlike(low, F.lit(rules.UNCERTAIN))
    g = hits.groupBy("qid").agg(F.round(F.avg("score"), 9).alias("mean"), F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n"), F.count_if(negated).alias("no"), F.count_if(unsure).alias("unsure"))
    reason = F.when(F.col("mean") < least, "low confidence").when(F.col("docs") < sources, "few sources").otherwise("sufficient")
    warnings = F.array_compact(F.array(F.when((F.col("no") > 0) & (F.col("no") < F.col("n")), "conflict"), F.when(F.col("unsure") > F.col("n") * 0.6, "uncertain")))
    return g.select("qid", (reason == "sufficient").alias("sufficient"), reason.alias("reason"), F.when(reason == "sufficient", F.array_join(warnings, ",")).otherwise("").alias("warnings"))
