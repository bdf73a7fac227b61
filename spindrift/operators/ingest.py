"""Ingestion: documents to cleaned text, chunks and vectors, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import chunking as C


@dataclass(frozen=True)
class Strategy:
    """What a pipeline does: chunk size in tokens, overlap, whether texts are deduplicated and vectors made."""

    most: int = 480
    overlap: int = 1
    dedup: bool = True
    vectors: bool = True


#: The pipelines by name.
STRATEGIES = {"fast": Strategy(most=240, dedup=False, vectors=False), "balanced": Strategy(), "comprehensive": Strategy(most=320, overlap=2), "vector_only": Strategy(dedup=False)}


def ingest(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], strategy: str = "balanced") -> DataFrame:
    """(doc_id, chunk_id, text, tokens, language, vec): meaningful documents, cleaned, cut and, by strategy, deduplicated and embedded."""
    s = STRATEGIES[strategy]
    # exploded, so that the checks read the cleaned text and don't clean it again each
    clean = docs.select("doc_id", F.explode(F.array(T.clean(F.col("text")))).alias("text")).where(T.meaningful(F.col("text")) & T.extracted_ok(F.col("text")))
    if s.dedup:
        first = clean.groupBy(F.sha2(F.lower("text"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
        clean = clean.join(first.select("doc_id"), "doc_id", "left_semi")
    cut = C.token_chunks(clean, "doc_id", s.most, s.overlap)
    out = cut.select("doc_id", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"), "text", "tokens", T.language(F.col("text")).alias("language"))
    if not s.vectors:
        return out.withColumn("vec", F.lit(None).cast("array<double>"))
    return C.with_vectors(out, "text", encode)
