"""Queries by name, each with its DuckDB SQL where there is one."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) function under a name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def flagship(spark, sf_dir):
    """BM25 hits for one fixed query."""
    return QUERIES["bm25_topk"](spark, sf_dir)


from spindrift.plans import answers, chains, chunking, dedup, extras, retrieval, store, stores, streams, text  # noqa: E402, F401  they register their queries
