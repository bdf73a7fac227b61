"""Chunking of sentence arrays: folds over token and character budgets, and by semantic cohesion.

Budget folds stay in the JVM: they keep boundaries only, and texts are cut from the sentence array at the end. Cohesion needs
vectors and runs row by row in Arrow batches; a document never leaves its row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import graph

_SPAN = "array<struct<a:int,b:int>>"
#: Titles that make a chunk more important.
IMPORTANT = ("introduction", "conclusion", "summary", "abstract", "einleitung", "zusammenfassung", "fazit")


def _sum(values: Column, a: Column, b: Column) -> Column:
    """Sum of values[a..b-1], from 0."""
    return F.aggregate(F.slice(values, a + 1, F.greatest(F.lit(0), b - a)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def token_spans(costs: Column, most: int = 480, overlap: int = 1) -> Column:
    """Spans [a, b) of sentences: filled until the next sentence's tokens would exceed `most`; each begins with the last `overlap` sentences of the one before, if that has as many."""

    def step(acc, cost):
        i, a, used, tail = acc["i"], acc["a"], acc["used"], acc["tail"]
        cut = (i > a) & (used + cost > most)
        back = F.when(i - a >= overlap, overlap).otherwise(0)
        kept = F.when(i - a >= overlap, F.aggregate(tail, F.lit(0).cast("bigint"), lambda s, x: s + x)).otherwise(F.lit(0).cast("bigint"))
        longer = F.array_append(tail, cost)
        return F.struct(
            (i + 1).alias("i"),
            F.when(cut, i - back).otherwise(a).alias("a"),
            (F.when(cut, kept).otherwise(used) + cost).alias("used"),
            (F.slice(longer, F.greatest(F.lit(1), F.size(longer) - overlap + 1), F.lit(overlap)) if overlap else tail).alias("tail"),
            F.when(cut, F.array_append(acc["out"], F.struct(a.alias("a"), i.alias("b")))).otherwise(acc["out"]).alias("out"),
        )

    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("used"), none.alias("tail"), F.array().cast(_SPAN).alias("out"))
    last = lambda acc: F.when(acc["i"] > acc["a"], F.array_append(acc["out"], F.struct(acc["a"].alias("a"), acc["i"].alias("b")))).otherwise(acc["out"])
    return F.aggregate(costs, zero, step, last)


def char_spans(lengths: Column, most: int, overlap: int) -> Column:
    """Spans of sentences: closed when one more and a blank would exceed `most` characters; each begins with the last sentences before it whose total stays under `overlap`."""

    def kept_of(current):
        fold = lambda s, x: F.when(s["open"] & (s["total"] + x < overlap), F.struct((s["total"] + x).alias("total"), (s["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(s["total"].alias("total"), s["n"].alias("n"), F.lit(False).alias("open")))
        return F.aggregate(F.reverse(current), F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("n"), F.lit(True).alias("open")), fold)

    def step(acc, size):
        i, a, used, current = acc["i"], acc["a"], acc["used"], acc["current"]
        cut = (used + size + 1 > most) & (i > a)
        kept = kept_of(current)
        return F.struct(
            (i + 1).alias("i"),
            F.when(cut, i - kept["n"]).otherwise(a).alias("a"),
            (F.when(cut, kept["total"]).otherwise(used) + size + 1).alias("used"),
            F.array_append(F.when(cut, F.slice(current, F.size(current) - kept["n"] + 1, kept["n"])).otherwise(current), size).alias("current"),
            F.when(cut, F.array_append(acc["out"], F.struct(a.alias("a"), i.alias("b")))).otherwise(acc["out"]).alias("out"),
        )

    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("used"), none.alias("current"), F.array().cast(_SPAN).alias("out"))
    last = lambda acc: F.when(acc["i"] > acc["a"], F.array_append(acc["out"], F.struct(acc["a"].alias("a"), acc["i"].alias("b")))).otherwise(acc["out"])
    return F.aggregate(lengths, zero, step, last)


def joined(sentences: Column, span: Column) -> Column:
    """Text of a span."""
    return F.array_join(F.slice(sentences, span["a"] + 1, span["b"] - span["a"]), " ")


def token_chunks(docs: DataFrame, key: str, most: int = 480, overlap: int = 1) -> DataFrame:
    """(key, n, a, b, text, tokens) of the token-budget chunks of docs (key, text)."""
    s = docs.select(key, T.sentences(F.col("text")).alias("s")).withColumn("cost", F.transform("s", T.approx_tokens))
    spans = s.select(key, "s", "cost", F.posexplode(token_spans(F.col("cost"), most, overlap)).alias("n", "x"))
    return spans.select(key, "n", F.col("x.a").alias("a"), F.col("x.b").alias("b"), joined(F.col("s"), F.col("x")).alias("text"), _sum(F.col("cost"), F.col("x.a"), F.col("x.b")).alias("tokens"))


def page_chunks(pages: DataFrame, key: str, page: str, most: int = 480, overlap: int = 1) -> DataFrame:
    """Chunks of paged documents (key, page, text): chunk_id, page_start, page_end, one_page, sentences, tokens, text. Only a document's own pages meet."""
    per = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(page, "text"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: F.transform(T.sentences(x["text"]), lambda s: F.struct(x[page].alias("page"), s.alias("s")))))
    s = per.select(key, flat.alias("x")).withColumn("cost", F.transform("x.s", T.approx_tokens))
    spans = s.select(key, "x", "cost", F.posexplode(token_spans(F.col("cost"), most, overlap)).alias("n", "sp"))
    own = F.slice("x", F.col("sp.a") + 1, F.col("sp.b") - F.col("sp.a"))
    cut = spans.select(key, "n", own.alias("own"), _sum(F.col("cost"), F.col("sp.a"), F.col("sp.b")).alias("tokens"))
    low, high = F.array_min("own.page"), F.array_max("own.page")
    return cut.select(key, F.concat_ws("_simple_", F.col(key).cast("string"), F.col("n").cast("string")).alias("chunk_id"), low.alias("page_start"), high.alias("page_end"), (low == high).alias("one_page"), F.size("own").cast("bigint").alias("n_sentences"), "tokens", F.array_join("own.s", " ").alias("text"))


def importance(section: Column, title: Column) -> Column:
    """1; in a section 0.1 less for each level below the first, 0.5 at least; 0.2 more for telling titles; 1.5 at most."""
    depth = F.size(F.filter(F.split(section, r"\."), lambda p: p != ""))
    base = F.when(section.isNull() | (section == ""), 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - 0.1 * (depth - 1)))
    telling = F.exists(F.array(*map(F.lit, IMPORTANT)), lambda w: F.contains(F.lower(F.coalesce(title, F.lit(""))), w))
    return F.least(F.lit(1.5), base + F.when(telling, 0.2).otherwise(0.0))


def heading_path(section: Column, title: Column) -> Column:
    """Dotted prefixes of a section number, then the title."""
    parts = F.filter(F.split(section, r"\."), lambda p: p != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))
    return F.concat(prefixes, F.when(F.coalesce(title, F.lit("")) != "", F.array(title)).otherwise(F.array().cast("array<string>")))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Term counts in hashed dimensions: near texts have near vectors, without a model."""

    def encode(texts: list[str]) -> np.ndarray:
        place = lru_cache(1 << 16)(lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dim)
        counts = [np.bincount([place(w) for w in t.lower().split()] or [0], minlength=dim) * bool(t.split()) for t in texts]
        return np.array(counts, np.float64).reshape(len(texts), dim)

    return encode


def seeded_embedder(dim: int = 64, boosts: tuple = ("insurance", "finance", "health", "cat", "dog"), boost: float = 6.0) -> Callable[[list[str]], np.ndarray]:
    """Repeatable normal vectors seeded by a text's SHA-1, nudged along one dimension for each telling word, of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha1(t.strip().lower().encode()).digest()[:8], "big") & 0x7FFFFFFFFFFFFFFF
            v = np.random.default_rng(seed).normal(size=dim).astype(np.float32)
            for i, k in enumerate(boosts[:dim]):
                v[i] += boost if k in t.lower() else 0
            out.append(v / max(np.linalg.norm(v), 1e-8))
        return np.array(out).reshape(len(texts), dim)

    return encode


#: Rows and bytes of text that are embedded at once; one longer text is a slice of its own.
TEXTS, TEXT_BYTES = 1024, 1 << 20


def slices(b: pa.RecordBatch, key: str, rows: int = TEXTS, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and `size` bytes of text in `key`, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(key)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield b.slice(at, min(to, b.num_rows) - at)
        at = to


def embed(texts: DataFrame, key: str, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(text, vec): each distinct text embedded once, in batches.

    The number of partitions is the session's and not the one that fits the texts' bytes, as vectors cost more than reading.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "vec": list(encode(f[key].tolist()).astype(float))})

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(key).where(F.col(key).isNotNull()).repartition(parts, key).dropDuplicates([key])
    return rows.mapInPandas(run, f"{key} string, vec array<double>")


def with_vectors(rows: DataFrame, key: str, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """`rows` with vec, of the text in `key`: in place, without a join; a text that a slice of a batch repeats is embedded once there.

    Slices end at `TEXTS` rows or `TEXT_BYTES` of text, so what a task holds depends neither on the length of the longest text nor on the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, key):
                coded = pc.dictionary_encode(pc.fill_null(part.column(key), ""))
                vectors = pa.array(list(np.asarray(encode(coded.dictionary.to_pylist()), np.float64)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors.take(coded.indices)], names=[*part.schema.names, "vec"])

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields), "vec array<double>"])
    return rows.mapInArrow(run, schema)


def frequent(rows: DataFrame, words: str, most: int, without: list[str]) -> list[str]:
    """The `most` most frequent words of the array column `words` that are not in `without`, equally frequent ones in order."""
    each = rows.select(F.explode_outer(words).alias("word")).where("word is not null")  # explode() would make the words twice, first for a filter on their number
    n = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    first = n.orderBy(F.desc("n"), "word").limit(most + len(without)).collect()  # a filter would be asked of each word of each text
    return [r.word for r in first if r.word not in set(without)][:most]


def term_counts(rows: DataFrame, key: str, words: str, vocabulary: list[str]) -> DataFrame:
    """(key, tf): sparse counts of the vocabulary's words. They are checkpointed, so that what is fitted on them in many passes does not cut the texts again."""
    graph.checkpoint_folder(rows.sparkSession)
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol=words, outputCol="tf")
    return model.transform(rows).select(key, "tf").checkpoint()


def cohesive(sentences: list[str], breaks: list, encode, most: int, threshold: float, overlap: int) -> list[tuple[int, int, float]]:
    """Spans and mean similarities: a sentence joins while it is near the chunk's mean direction, fits the budget, and no break value (page, section) changes."""
    if not sentences:
        return []
    cost = [max(1, round(len(s.split()) / 1.3)) for s in sentences]
    v = encode(sentences)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    out, a, total, used, near = [], 0, v[0].copy(), cost[0], []
    for i in range(1, len(sentences)):
        similarity = float(v[i] @ total / max(np.linalg.norm(total), 1e-8))
        if breaks[i] == breaks[i - 1] and similarity >= threshold and used + cost[i] <= most:
            total, used = total + v[i], used + cost[i]
            near.append(similarity)
            continue
        out.append((a, i, float(np.mean([*near, similarity]))))
        a = max(i - overlap, a) if overlap else i
        total, used, near = v[a : i + 1].sum(0), sum(cost[a : i + 1]), []
    return [*out, (a, len(sentences), float(np.mean(near)) if near else 1.0)]


def semantic_chunks(docs: DataFrame, key: str, encode, most: int = 480, threshold: float = 0.62, overlap: int = 1) -> DataFrame:
    """(key, n, a, b, tokens, similarity, text) of docs (key, s array<struct<page, s>>): cohesive chunks, broken where the page changes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, parts in zip(f[key], f["s"], strict=True):
                texts, pages = [p["s"] for p in parts], [p["page"] for p in parts]
                for n, (a, b, near) in enumerate(cohesive(texts, pages, encode, most, threshold, overlap)):
                    text = " ".join(texts[a:b])
                    rows.append((k, n, a, b, max(1, round(len(text.split()) / 1.3)), near, text))
            yield pd.DataFrame(rows, columns=[key, "n", "a", "b", "tokens", "similarity", "text"])

    return docs.select(key, "s").mapInPandas(run, f"{key} long, n long, a long, b long, tokens long, similarity double, text string")
