"""Joins of large row sets with query sets, block by block, with a top k that merges.

Rows and queries are packed into blocks of bounded size, a row of one binary each. A task is given pairs of blocks, works on both as matrices and keeps the k best of
each query it has seen, so memory does not depend on how many rows or queries there are, and no pair of single rows is ever put out. Query blocks are broadcast if they are
counted to be small; more go through a join of partitions, which spills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of packed queries that every task is given at most; candidates that a task holds before it cuts them to the k best of each query; cells of the matrix that a kernel makes at once.
BROADCAST_BYTES, HELD, CELLS = 64 << 20, 1 << 19, 1 << 20


def top(scored: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query with their rank from 1; scores equal to nine places go by id. Spark cuts to k before the shuffle."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.round(score, 9).desc(), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def _cuts(t: pa.Table, size: int, on: str | None, whole: str | None, groups: int) -> list[int]:
    """Where blocks end: at `size` rows or `groups` different values of `whole`, never inside one of them, and where `on` changes."""
    n = t.num_rows
    change = lambda c: np.flatnonzero(np.concatenate([[True], (v := t[c].to_numpy())[1:] != v[:-1]]))
    starts = change(whole) if whole else np.arange(n)
    forced = set(change(on).tolist()) if on else {0}
    bounds = [*starts.tolist(), n]
    cuts, at, held = [], 0, 0
    for i in range(1, len(bounds)):
        held += 1
        last = i == len(bounds) - 1
        if last or bounds[i] in forced or held >= groups or bounds[i + 1] - at > size:
            cuts.append(bounds[i])
            at, held = bounds[i], 0
    return cuts


def packed(rows: DataFrame, size: int, on: str | None = None, whole: str | None = None, groups: int = 1 << 30) -> DataFrame:
    """(on, data): blocks of `rows`. For `on` and `whole` rows have to be sorted by them in their partitions."""

    def write(t: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(t: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            cuts = _cuts(t, size, on, whole, groups) if t.num_rows else []
            cuts = cuts if last else cuts[:-1]
            made, at = [], 0
            for c in cuts:
                part = t.slice(at, c - at).combine_chunks()
                data = pa.array([write(part)], pa.binary())
                made.append(pa.RecordBatch.from_arrays([pa.array([part[on][0].as_py()], part[on].type), data] if on else [data], names=[on, "data"] if on else ["data"]))
                at = c
            return made, t.slice(at)

        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows >= 2 * size:
                made, held = blocks(held.combine_chunks(), False)
                yield from made
        if held is not None and held.num_rows:
            yield from blocks(held.combine_chunks(), True)[0]

    kind = f"`{on}` {rows.schema[on].dataType.simpleString()}, " if on else ""
    return rows.mapInArrow(run, kind + "data binary")


def cut(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) of each query."""
    order = np.lexsort((i, -np.round(s, 9), q))
    q, i, s = q[order], i[order], s[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
    return q[place < k], i[place < k], s[place < k]


def best(rows: DataFrame, queries: DataFrame, kernel: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, on: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best of each query over all pairs of blocks (of equal `on`, if given).

    kernel(rows, queries) gives (qid, id, score) arrays of the k best of each query in the pair, and no more, so that a task holds `HELD` candidates and those of one pair at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[pa.Buffer, pa.Table] | None = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def out(t: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t[0], pa.int64()), pa.array(t[1], pa.int64()), pa.array(t[2], pa.float64())], names=["qid", "id", "score"])

        read = lambda x: pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks()
        for b in batches:
            for r, q in zip(b.column(0), b.column(1), strict=True):
                raw = r.as_buffer()
                if seen is None or not seen[0].equals(raw):
                    data = pa.py_buffer(raw.to_pybytes())  # a copy, so that no batch outlives its turn
                    seen = (data, pa.ipc.open_stream(data).read_all().combine_chunks())
                held.append(kernel(seen[1], read(q)))
                count += len(held[-1][0])
                if count > HELD:
                    merged = cut(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                    held, count = [merged], len(merged[0])
                    if count > HELD // 2:
                        yield out(merged)
                        held, count = [], 0
        if held:
            yield out(cut(*(np.concatenate(x) for x in zip(*held, strict=True)), k))
        pa.default_memory_pool().release_unused()

    size = queries.agg(F.sum(F.length("data"))).first()[0] or 0
    asked = queries.withColumnRenamed("data", "q")
    asked = F.broadcast(asked) if size <= BROADCAST_BYTES else asked
    pairs = rows.join(asked, on) if on else rows.crossJoin(asked)
    return top(pairs.select("data", "q").mapInArrow(run, "qid long, id long, score double"), k)


def vectors_of(t: pa.Table, column: str = "vec") -> np.ndarray:
    """Rows of an array column as a matrix of unit rows."""
    flat = t[column].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def _best_cells(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the cells that score no less than their row's k-th to nine places; -inf is no cell."""
    near = np.round(s, 9)
    if near.shape[1] > k:
        near[near < np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]] = -np.inf
    return np.nonzero(near > -np.inf)


def _parts(n: int, width: int) -> list[slice]:
    """Slices of n queries whose matrix with `width` rows has `CELLS` cells at most, or one query."""
    step = max(1, CELLS // max(1, width))
    return [slice(at, min(n, at + step)) for at in range(0, n, step)]


def _at_most(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """No more than k of each query; cut only where equal scores gave more."""
    return cut(q, i, s, k) if len(q) and np.unique(q, return_counts=True)[1].max() > k else (q, i, s)


def _joined(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


def cosine(k: int) -> Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kernel of blocks (id, vec) and (qid, vec): the k best of each query."""

    def kernel(rows: pa.Table, queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, qids, v, u = rows["id"].to_numpy(), queries["qid"].to_numpy(), vectors_of(rows).T, vectors_of(queries)
        found = []
        for part in _parts(len(qids), len(ids)):
            s = np.round(u[part] @ v, 12)
            q, i = _best_cells(s, k)
            found.append(_at_most(qids[part][q], ids[i], s[q, i], k))
        return _joined(found)

    return kernel


def sparse(k: int) -> Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kernel of blocks (id, term, value) and (qid, term, value) of sparse vectors, whole rows and queries in each: the k best inner products of each query with rows that share a term."""

    def kernel(rows: pa.Table, queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, of_row = np.unique(rows["id"].to_numpy(), return_inverse=True)
        qids, of_query = np.unique(queries["qid"].to_numpy(), return_inverse=True)
        a, x = rows["term"].to_numpy(), rows["value"].to_numpy()
        order = np.argsort(a, kind="stable")
        a, x, of_row = a[order], x[order], of_row[order]
        terms, values = queries["term"].to_numpy(), queries["value"].to_numpy()
        found = []
        for part in _parts(len(qids), len(ids)):
            own = np.flatnonzero((of_query >= part.start) & (of_query < part.stop))
            own = own[np.argsort(terms[own], kind="stable")]
            b, y, to = terms[own], values[own], of_query[own] - part.start
            s, hit = np.zeros((part.stop - part.start, len(ids))), np.zeros((part.stop - part.start, len(ids)), bool)
            for t in np.intersect1d(a, b).tolist():
                i, j = slice(*np.searchsorted(a, [t, t + 1])), slice(*np.searchsorted(b, [t, t + 1]))
                cell = np.ix_(to[j], of_row[i])
                s[cell] += y[j, None] * x[None, i]
                hit[cell] = True
            s[~hit] = -np.inf
            q, i = _best_cells(s, k)
            found.append(_at_most(qids[part][q], ids[i], s[q, i], k))
        return _joined(found)

    return kernel
