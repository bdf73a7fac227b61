"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. An n-gram vector binds its letters: the
element-wise product of their vectors, each cyclically permuted by its place. A text bundles (adds) the vectors of
its 3-grams; a language's prototype bundles those of its training texts. A text gets the
language whose prototype has the largest cosine with it.

A text that is null or has no letter gets `und` with score 0, as does every text if nothing was learned. Equal cosines
go to the first language by name. Repeated rows are learned from as often as they occur and get equal results. Long texts are read in blocks and bundled block by block, so that
memory is bounded; sums are of integers, so reruns agree. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.arrow import ROWS, lean, release

#: Dimension of all vectors; symbols that letters map to (0: what is no letter); characters read at a time; texts bundled at a time.
DIM, SYMBOLS, BLOCK, TEXTS = 1024, 4096, 1 << 20, 64
_SHIFT = SYMBOLS.bit_length() - 1
UND = "und"


@cache
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for non-letters, else 1 + code point modulo 4093, so that no two letters of the alphabets below U+0FFD share one."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letter, 1 + points % 4093, 0).astype(np.int16)


@cache
def _vectors(seed: int = 11) -> tuple[np.ndarray, ...]:
    """The symbols' vectors, and permuted by one place and by two."""
    bits = np.unpackbits(np.frombuffer(np.random.default_rng(seed).bytes(SYMBOLS * DIM // 8), np.uint8))
    v = (bits.reshape(SYMBOLS, DIM).astype(np.int8) << 1) - 1
    return v, np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)


def bind(codes: np.ndarray) -> np.ndarray:
    """The 3-grams' vectors, a row each."""
    v0, v1, v2 = _vectors()
    return v2[codes >> 2 * _SHIFT] * v1[codes >> _SHIFT & SYMBOLS - 1] * v0[codes & SYMBOLS - 1]


def grams(text: str | None, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Codes of the 3-grams of the lower-cased letters, other runs as one space, block by block."""
    kept = np.zeros(1, np.int16)
    some = False
    size = len(text or "")
    for at in range(0, size, block):
        raw = text[at : at + block].lower().encode("utf-32-le", "surrogatepass")
        s = np.concatenate([kept, _symbols()[np.frombuffer(raw, np.uint32)], np.zeros(int(at + block >= size), np.int16)])
        some = some or bool(s.any())
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        if some and len(s) > 2:
            s = s.astype(np.int64)
            yield (s[:-2] << 2 * _SHIFT) | (s[1:-1] << _SHIFT) | s[2:]
        kept = s[-2:]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of texts, a row each, and whether each has a letter."""
    out, lettered = np.zeros((len(texts), DIM)), np.zeros(len(texts), bool)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if held:
            codes, place = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
            rows, of = np.unique([i for i, _, _ in held], return_inverse=True)
            counts = np.zeros((len(rows), len(codes)), np.float32)
            np.add.at(counts, (np.repeat(of, [len(c) for _, c, _ in held]), place), np.concatenate([n for _, _, n in held]))
            for k in range(0, len(codes), 4096):
                out[rows] += counts[:, k : k + 4096] @ bind(codes[k : k + 4096]).astype(np.float32)
            held.clear()

    for i, text in enumerate(texts):
        for part in grams(text):
            lettered[i] = True
            codes, n = np.unique(part, return_counts=True)
            held.append((i, codes, n.astype(np.float32)))
        if len(held) >= TEXTS:
            flush()
    flush()
    return out, lettered


@dataclass(frozen=True)
class Prototypes:
    """Languages by name, and their bundled vectors, a row each."""

    langs: tuple[str, ...]
    vectors: np.ndarray


def train(docs: DataFrame) -> Prototypes:
    """Prototypes from every row with text and lang. What reaches the driver is a vector for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        held: dict[str, int] = defaultdict(int)

        def merge(lang: str) -> None:
            codes, place = np.unique(np.concatenate([c for c, _ in seen[lang]]), return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, place, np.concatenate([n for _, n in seen[lang]]))
            seen[lang], held[lang] = [(codes, total)], 0

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in grams(text):
                    codes, n = np.unique(part, return_counts=True)
                    seen[lang].append((codes, n))
                    held[lang] += len(codes)
                if held[lang] > 1 << 20:
                    merge(lang)
        for lang in sorted(seen):
            merge(lang)
            codes, n = seen[lang][0]
            total = sum(n[k : k + 1024] @ bind(codes[k : k + 1024]).astype(np.int64) for k in range(0, len(codes), 1024))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total)], names=["lang", "at", "v"]
            )

    rows = docs.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(lean(run), "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).toPandas()
    wide = sums.pivot(index="lang", columns="at", values="v").sort_index()
    return Prototypes(tuple(wide.index), wide.to_numpy(np.float64) if len(wide) else np.zeros((0, DIM)))


def classify(texts: list[str | None], known: Prototypes) -> tuple[list[str], np.ndarray]:
    """Language and cosine (negative: 0) of each text."""
    if not known.langs or not texts:
        return [UND] * len(texts), np.zeros(len(texts))
    v, lettered = bundles(texts)
    unit = known.vectors / np.maximum(np.linalg.norm(known.vectors, axis=1, keepdims=True), 1e-300)
    cosine = v @ unit.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    best = cosine.argmax(1)
    score = np.where(lettered, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
    return [known.langs[i] if ok else UND for i, ok in zip(best, lettered, strict=True)], score


def predict(docs: DataFrame, known: Prototypes, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The carried columns with lang_pred and score. Reads the text only; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score = classify(b.column(0).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs), pa.array(score)], names=[*carry, "lang_pred", "score"])

    rows = docs.select(F.col("text").cast("string").alias("__text"), *carry)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "lang_pred string", "score double"])
    return rows.mapInArrow(lean(run), schema)


def column(text: Column, known: Prototypes) -> Column:
    """struct<lang_pred, score> of a text column; only the texts go to Python."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [classify(texts[k : k + ROWS].to_pylist(), known) for k in range(0, len(texts), ROWS)]
        langs, scores = pa.array([x for p in parts for x in p[0]], pa.string()), pa.array([float(x) for p in parts for x in p[1]], pa.float64())
        release()
        return pa.StructArray.from_arrays([langs, scores], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")(text)


def held_out(doc_id: Column) -> Column:
    """True for the documents that are not learned from: crc32 of the id as text leaves 1 when divided by 3. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
