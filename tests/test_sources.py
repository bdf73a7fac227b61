"""Files in and out."""

import json

from pyspark.sql import functions as F

from spindrift.operators import graph
from spindrift.sources import files


def test_binaries_and_extractors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("page one\fpage two ", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe broken")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"y" * 100)

    def last_resort(content):
        return ["rescued"] if content.startswith(b"\xff") else []

    found = files.binaries(spark, str(tmp_path), (".txt",), largest=50)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(found, [files.plain_text, last_resort]).collect()}
    assert set(got) == {"a.txt", "b.txt"}
    assert [(p.page, p.text) for p in got["a.txt"].pages] == [(1, "page one"), (2, "page two")] and got["a.txt"].method == "plain_text"
    assert got["b.txt"].method == "last_resort" and got["b.txt"].error is None
    failed = files.extract(found, [lambda c: 1 / 0]).collect()
    assert all(r.method is None and "division" in r.error for r in failed)


def test_sets(spark, tmp_path):
    csv = tmp_path / "train.csv"
    csv.write_text('text,label\n"a, b",x\n"two\nlines",y\n', encoding="utf-8")
    assert [tuple(r) for r in files.dataset(spark, str(csv)).collect()] == [("a, b", "x"), ("two\nlines", "y")]
    js = tmp_path / "test.json"
    js.write_text(json.dumps([{"text": " a ", "label": 0}, {"text": "  ", "label": 1}, {"text": "b", "label": 9}, {"text": "c", "label": 1}]), encoding="utf-8")
    assert [tuple(r) for r in files.test_set(spark, str(js), 2).collect()] == [("a", 0), ("c", 1)]
    assert files.test_set(spark, str(js), 2, 1).count() == 1
    labels = tmp_path / "labels.txt"
    labels.write_text(" one \n\n two\n", encoding="utf-8")
    assert [r.label for r in files.label_file(spark, str(labels)).collect()] == ["one", "two"]


def test_resume(spark, tmp_path):
    log = tmp_path / "state.jsonl"
    log.write_text("\n".join(json.dumps({"file": f, "status": s, "ts": t}) for f, s, t in [("a", "ok", "1"), ("b", "error", "1"), ("b", "ok", "2"), ("c", "ok", "1"), ("c", "error", "2")]), encoding="utf-8")
    todo = files.to_do(spark.createDataFrame([(x,) for x in "abcd"], "file string"), files.resume(spark, str(log)))
    assert sorted(r.file for r in todo.collect()) == ["c", "d"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    for form in ("json", "csv", "parquet"):
        files.report(df, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["id", "v"]


def test_vector_store(spark, tmp_path):
    out = str(tmp_path / "sent")

    def send(rows):
        with open(out, "a", encoding="utf-8") as f:
            f.write(json.dumps(len(rows)) + "\n")

    files.to_vector_store(spark.range(25).coalesce(1).select(F.col("id")), send, batch=10)
    assert [int(x) for x in open(out, encoding="utf-8").read().split()] == [10, 10, 5]


def test_leaders(spark):
    import random

    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    want, near = {}, {i: set() for i in range(60)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for i in sorted(near):
        if near[i] and i not in want:
            want[i] = i
            for j in near[i]:
                if j > i:
                    want.setdefault(j, i)
    got = {r.id: r.leader for r in graph.leaders(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == want
