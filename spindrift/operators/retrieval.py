"""Lexical and dense retrieval, fusion, diversification, reranking and summaries over DataFrames of hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import blocks, lexical
from spindrift.operators.blocks import top

#: Vectors in a block of rows and in one of queries.
ROWS, QUERIES = 4096, 512


def bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best chunks (id, text) for each of the queries (qid, text), chunks of score 0 last."""
    return lexical.search(lexical.over(chunks), queries, k)


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k nearest vectors (id, vec) by cosine for each of the queries (qid, vec), block by block. Rows without a vector are left out."""
    rows = blocks.packed(vectors.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null"), ROWS)
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "vec").where("vec is not null")
    return blocks.best(rows, blocks.packed(asked.repartition(max(1, -(-asked.count() // QUERIES))), QUERIES), blocks.cosine(k), k)


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(qid, id, score, rank) of all hits in any list: sum of 1 / (k + rank); equal scores go by first list and rank there."""
    both = None
    for i, x in enumerate(lists):
        own = x.select("qid", "id", "rank", F.lit(i).alias("list"))
        both = own if both is None else both.unionByName(own)
    fused = both.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = W.partitionBy("qid").orderBy(F.round("score", 12).desc(), "first")
    return fused.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("first")


def min_max(scored: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Scores of each query's list from 0 to 1; a constant list gets 0."""
    w = W.partitionBy("qid")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return scored.withColumn("score", (F.col("score") - low) / F.when(span == 0, floor).otherwise(span))


def weighted(a: DataFrame, b: DataFrame, wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    """(qid, id, score, rank): weighted sum of the lists' min-max scores, 0 where one lacks the hit."""
    x, y = min_max(a).select("qid", "id", F.col("score").alias("sa")), min_max(b).select("qid", "id", F.col("score").alias("sb"))
    both = x.join(y, ["qid", "id"], "full_outer").select("qid", "id", (wa * F.coalesce("sa", F.lit(0.0)) + wb * F.coalesce("sb", F.lit(0.0))).alias("score"))
    return top(both, 2**31 - 1)


def mmr(candidates: DataFrame, k: int, weight: float = 0.65) -> DataFrame:
    """(qid, id, place): greedy choice by weight * similarity to the query less (1 - weight) * the largest to what is chosen.

    candidates: (qid, id, rank, vec, qvec), a list cut to its first ones; a query's list is handled in one call.
    """

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", kind="stable")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
        v, q = unit(np.array(f["vec"].tolist(), np.float64)), unit(np.array(f["qvec"].tolist()[:1], np.float64))
        near, most = (v @ q.T).ravel(), np.zeros(len(f))
        left, out = np.ones(len(f), bool), []
        while left.any() and len(out) < k:
            score = np.where(left, np.round(weight * near - (1 - weight) * most, 12), -np.inf)
            i = int(score.argmax())
            out.append(i)
            left[i] = False
            most = np.maximum(most, v @ v[i])
        return pd.DataFrame({"qid": f["qid"].iloc[0], "id": f["id"].to_numpy()[out], "place": np.arange(1, len(out) + 1)})

    return candidates.groupBy("qid").applyInPandas(pick, "qid long, id long, place long")


def term_score(query: Column, text: Column) -> Column:
    """Reranking score: 2 ln(1 + occurrences) of each alphabetic query word, over ln of the text's length."""
    low = F.lower(text)
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.rlike(w, F.lit(r"^\p{L}+$")))
    count = lambda w: (F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w)
    total = F.aggregate(F.transform(words, lambda w: 2.0 * F.log1p(count(w))), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(words) == 0) | (low == ""), 0.0).otherwise(total / F.log(F.greatest(F.lit(20), F.length(text))))


def scored_by(scorer: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """Reranking score of a plug-in, such as a cross-encoder: a function of a batch of (query, text) pairs that gives their scores."""

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(zip(query, text, strict=True))), dtype="float64")

    return score


def retrieve(vectors: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, dense_k: int = 8, lexical_k: int = 12, scorer: Callable | None = None, budget: int = 160) -> DataFrame:
    """(qid, id, rank, place, score, summary): dense and lexical hits of queries (qid, text, vec), fused by reciprocal ranks, diversified to k, reranked and summarised.

    `place` is the one before reranking. Vectors (id, vec) and chunks (id, text) have the same ids; a hit that lacks either is left out. `scorer` replaces the term score.
    """
    fused = rrf([dense(vectors, queries.select("qid", "vec"), dense_k), bm25(chunks, queries.select("qid", "text"), lexical_k)]).where(F.col("rank") <= max(4 * k, k + 5))
    found = fused.join(vectors.select("id", "vec"), "id").join(queries.select("qid", F.col("vec").alias("qvec")), "qid")
    picked = mmr(found, k).join(chunks.select("id", "text"), "id").join(queries.select("qid", F.col("text").alias("query")), "qid")
    score = (scored_by(scorer) if scorer else term_score)(F.col("query"), F.col("text"))
    return top(picked.withColumn("score", score), k).select("qid", "id", "rank", "place", "score", summary(F.col("query"), F.col("text"), budget).alias("summary"))


def summary(query: Column, text: Column, budget: int = 160, most: int = 3) -> Column:
    """Best sentences by matched words over the root of their length, in that order, as they fit the budget; else the first sentence."""
    asked = F.array_distinct(T.tokens(query))
    parts = T.sentences(text)

    def scored(s, i):
        toks = T.tokens(s)
        hits = F.size(F.filter(toks, lambda t: F.array_contains(asked, t)))
        return F.struct((-F.round(F.when(F.size(toks) > 0, hits / F.sqrt(F.size(toks))).otherwise(0.0), 9)).alias("order"), i.alias("i"), F.size(toks).alias("n"), s.alias("s"))

    order = F.sort_array(F.filter(F.transform(parts, scored), lambda x: x["order"] < 0))
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def take(acc, x):
        fits = (acc["used"] + x["n"] <= budget) & (F.size(acc["out"]) < most)
        return F.when(fits, F.struct((acc["used"] + x["n"]).alias("used"), F.array_append(acc["out"], x["s"]).alias("out"))).otherwise(acc)

    chosen = F.aggregate(order, empty, take)["out"]
    return F.when(F.size(chosen) > 0, F.array_join(chosen, " ")).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
