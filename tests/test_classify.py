from spindrift.operators import classify as C


def plugin(calls=None):
    """A classifier that notes the sizes of its calls; made here, so that it goes to the tasks by value."""

    def model(texts):
        if calls is not None:
            calls.append(len(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        return [("a" if "a" in t else "b", 0.25) for t in texts][: -1 if "short" in texts[0] else None]

    return model


def test_failing_texts_are_isolated():
    calls = []
    model = plugin(calls)
    texts = [f"text {i}" if i not in (5, 40) else f"bad {i}" for i in range(64)]
    got = C.judged(texts, model)
    assert [g[2] for g in got] == ["RuntimeError: bad text" if i in (5, 40) else None for i in range(64)] and all(g[0] == "b" for i, g in enumerate(got) if i not in (5, 40))
    assert len(calls) <= 1 + 2 * 2 * 6
    assert C.judged(["short"], model) == [(None, None, "ValueError: 0 results for 1 texts")] and C.judged([], model) == []


def test_a_row_for_every_text(spark):
    model = plugin()
    rows = [(i, t, "x") for i, t in enumerate([None, "", " \n", "an a", "bad", "bx", "bad a", *["b"] * 200])]
    df = spark.createDataFrame(rows, "id long, text string, error string").repartition(3)
    got = {r.id: r for r in C.classify(df, model, batch=16).collect()}
    assert len(got) == len(rows) and got[3].result.label == "a" and got[3].error is None and got[4].result is None and got[6].error == "RuntimeError: bad text"
    assert all(got[i].error == "ValueError: empty text" for i in range(3))
    s = C.summary(C.classify(df, model)).first()
    assert (s.total, s.successful, s.failed, s.mean_confidence, s.labels) == (207, 202, 5, 0.25, {"a": 1, "b": 201})
    none = C.summary(C.classify(df.limit(0), model)).first()
    assert (none.total, none.failed, none.mean_confidence, none.labels) == (0, 0, None, {})
