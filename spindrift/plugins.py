"""Plug-ins by port and name, chosen by settings, and text models that fall back to what an engine without a model would give; chunks as a table function of SQL.

A port is what a plug-in stands in for. Each has a default that needs no model, or none at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import chunking

#: Ports and the name of each one's default; None: without a plug-in, the step is left out.
PORTS: dict[str, str | None] = {"embedder": "hashing", "index": "exact", "reranker": None, "summarizer": None, "rewriter": None, "expander": None, "answerer": None}


class Unknown(LookupError):
    """A port that there is not."""


@dataclass
class Registry:
    """Factories by port and name. `resolve` makes what the settings name; a name that is not known, or a factory that fails, gives the port's default and is noted in `missing`."""

    factories: dict[tuple[str, str], Callable[..., object]] = field(default_factory=dict)
    missing: dict[str, str] = field(default_factory=dict)

    def add(self, port: str, name: str, factory: Callable[..., object]) -> None:
        if port not in PORTS:
            raise Unknown(port)
        self.factories[port, name] = factory

    def make(self, port: str, name: str | None = None, **options: object) -> object | None:
        """One plug-in; None where the port has no default and nothing was asked for, or what was asked for is not there."""
        if port not in PORTS:
            raise Unknown(port)
        default = PORTS[port]
        if name and name != default:
            try:
                return self.factories[port, name](**options)
            except Exception as x:  # noqa: BLE001  a model that is not installed or not reachable must not stop the run
                self.missing[port] = f"{name}: {type(x).__name__}"
        return self.factories[port, default]() if default and (port, default) in self.factories else None

    def resolve(self, settings: dict[str, object]) -> dict[str, object | None]:
        """A plug-in, or None, for every port. A setting is a name, or a dict with a name and options."""
        asked = {port: s if isinstance(s, dict) else {"name": s} for port, s in settings.items()}
        if strange := set(asked) - set(PORTS):
            raise Unknown(", ".join(sorted(strange)))
        return {port: self.make(port, **asked.get(port, {})) for port in PORTS}


def registry() -> Registry:
    """A registry that knows the embedders that need no model."""
    known = Registry()
    known.add("embedder", "hashing", chunking.hashing_embedder)
    known.add("embedder", "seeded", chunking.seeded_embedder)
    return known


Model = Callable[[list[str]], list[str | None]]


def _asked(texts: list[str], model: Model) -> list[str | None]:
    """The model's answers; a batch that fails is halved until the failing texts are alone, which get none."""
    if not texts:
        return []
    try:
        found = list(model(texts))
        if len(found) != len(texts):
            raise ValueError("as many answers as texts")
        return [None if x is None or not str(x).strip() else str(x) for x in found]
    except Exception:  # noqa: BLE001  any failure of a model means the fallback
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return _asked(texts[:half], model) + _asked(texts[half:], model)


def modelled(rows: DataFrame, text: Column, out: str, model: Model | None, fallback: Column, batch: int = 64) -> DataFrame:
    """`rows` with `out`: what a model (of a rewriter, expander or answerer) says of a text, asked in batches; where it fails or says nothing, and where there is no model, the fallback.

    Null texts are not asked about. `out` must not be a column of `rows`.
    """
    if model is None:
        return rows.withColumn(out, fallback)

    def run(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        said: list[str | None] = [None] * len(given)
        full = [i for i, t in enumerate(given) if t is not None]
        for k in range(0, len(full), batch):
            part = full[k : k + batch]
            for i, x in zip(part, _asked([given[i] for i in part], model), strict=True):
                said[i] = x
        return pa.array(said, pa.string())

    return rows.withColumn(out, F.coalesce(F.arrow_udf(run, "string")(text), fallback))


class Chunks:
    """Table function: chunks (n, sentences, tokens, chunk) of a text by a budget of tokens, each after the first beginning with the last `overlap` sentences of the one before."""

    def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
        parts = [p.strip(" \t\n\x0b\f\r") for p in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", (text or "").strip(" \t\n\x0b\f\r"))]
        held: list[tuple[str, int]] = []
        n = used = 0
        for s in filter(None, parts):
            cost = max(1, math.floor(len([w for w in re.split(r"[ \t\n\x0b\f\r]+", s) if w]) / 1.3 + 0.5))
            if held and used + cost > most:
                yield n, len(held), used, " ".join(x for x, _ in held)
                n, held = n + 1, held[-overlap:] if 0 < overlap <= len(held) else []
                used = sum(c for _, c in held)
            held.append((s, cost))
            used += cost
        if held:
            yield n, len(held), used, " ".join(x for x, _ in held)


def register(spark: SparkSession) -> None:
    """Makes `chunk_text(text, most, overlap)` known to SQL, for lateral joins."""
    spark.udtf.register("chunk_text", F.udtf(Chunks, returnType="n long, sentences long, tokens long, chunk string"))
