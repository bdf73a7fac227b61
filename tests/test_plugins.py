"""Plug-ins by settings, models with fallbacks, and chunks by a lateral join."""

import pytest
from pyspark.sql import functions as F

from spindrift import plugins
from spindrift.operators import chunking


def test_settings_choose_plugins_and_missing_ones_fall_back():
    r = plugins.registry()
    r.add("reranker", "model", lambda: 1 / 0)
    r.add("rewriter", "upper", lambda suffix="": lambda texts: [t.upper() + suffix for t in texts])
    got = r.resolve({"embedder": "absent", "reranker": "model", "rewriter": {"name": "upper", "suffix": "!"}})
    assert set(got) == set(plugins.PORTS) and got["reranker"] is None and got["rewriter"](["a"]) == ["A!"]
    assert (got["embedder"](["a b"]) == chunking.hashing_embedder()(["a b"])).all()
    assert r.missing == {"embedder": "absent: KeyError", "reranker": "model: ZeroDivisionError"}
    with pytest.raises(plugins.Unknown):
        r.resolve({"oracle": "x"})
    with pytest.raises(plugins.Unknown):
        r.add("oracle", "x", dict)


def test_models_fall_back_row_by_row(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [None if t == "silent" else "  " if t == "blank" else t[::-1] for t in texts]

    rows = spark.createDataFrame([(t,) for t in ["abc", "bad one", "silent", "blank", None, "xy", ""]], "q string").coalesce(1)
    own = F.concat(F.lit("own "), F.coalesce("q", F.lit("-")))
    got = {r.q: r.a for r in plugins.modelled(rows, F.col("q"), "a", model, own, batch=3).collect()}
    assert got == {"abc": "cba", "bad one": "own bad one", "silent": "own silent", "blank": "own blank", None: "own -", "xy": "yx", "": "own "}
    assert {r.a for r in plugins.modelled(rows, F.col("q"), "a", None, own).collect()} == {f"own {q or '-'}" if q is None else f"own {q}" for q in got}


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_lateral_chunks_equal_the_columns(spark, overlap):
    plugins.register(spark)
    texts = [(i, " \n".join(f"Sentence {j} has {'word ' * (j * i % 9)}here{'.!?'[j % 3]}" for j in range(i % 23))) for i in range(50)] + [(90, None), (91, " "), (92, "long " * 500)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = spark.sql(f"SELECT id, c.n, c.sentences, c.tokens, c.chunk FROM {{d}}, LATERAL chunk_text(text, 30, {overlap}) c", d=df).collect()
    want = chunking.token_chunks(df, "id", 30, overlap).select("id", "n", F.col("b") - F.col("a"), "tokens", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
