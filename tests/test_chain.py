"""Files to stamped chunks: every file gives chunks or one failure."""

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import chunking
from spindrift.sources import chain, files


GOOD = "The first sentence stands here. A second one follows it. "


def test_files_become_chunks_or_one_failure(spark, tmp_path):
    def sealed(content):
        if not content.startswith(b"SEALED"):
            raise ValueError("not sealed")
        return chain.Opened(["", ""], encrypted=True)

    (tmp_path / "a.txt").write_text("\f" + GOOD * 3 + "\f" + "The last page has this sentence.", encoding="utf-8")
    (tmp_path / "b.html").write_text("<html><script>var hidden = 'never';</script><h1>Title of it</h1><p>A paragraph &amp; more of it.</p></html>", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe broken")
    (tmp_path / "d.txt").write_bytes(b"SEALED with a word")
    (tmp_path / "e.txt").write_bytes(b" \f ")
    (tmp_path / "f.txt").write_bytes(b"?! short 1")
    (tmp_path / "g.txt").write_text("\f\f\f" + GOOD, encoding="utf-8")
    found = chain.read(files.binaries(spark, str(tmp_path), (".txt", ".html")), [("sealed", sealed), *chain.READERS])
    name = F.element_at(F.split("path", "/"), -1).alias("f")
    got = {r.f: tuple(r)[1:] for r in found.select(name, "page_count", "encrypted", "has_text", "method", "error").collect()}
    assert got == {
        "a.txt": (3, False, True, "text", None),
        "b.html": (1, False, True, "html", None),
        "c.txt": (None, False, False, None, "sealed: ValueError; html: UnicodeDecodeError; text: UnicodeDecodeError"),
        "d.txt": (2, True, False, None, "encrypted"),
        "e.txt": (2, False, False, None, "sealed: ValueError; html: ValueError; text: no text"),
        "f.txt": (1, False, True, "text", None),
        "g.txt": (4, False, False, "text", None),
    }
    out = chain.chunks(found, "acme", most=12, overlap=0, ingested_at="2024-01-01T00:00:00").select(name, "*")
    rows = out.collect()
    failed = {r.f: r.error for r in rows if r.error}
    assert set(failed) == {"c.txt", "d.txt", "e.txt", "f.txt"} and sum(bool(r.error) for r in rows) == 4 and failed["f.txt"] == "no meaningful text"
    assert all(r.chunk_id is None and r.text is None and r.n is None for r in rows if r.error)
    a = sorted((r for r in rows if r.f == "a.txt"), key=lambda r: r.n)
    assert [r.n for r in a] == list(range(len(a))) and " ".join(r.text for r in a) == (GOOD * 3).strip() + " The last page has this sentence."
    assert a[0].page_start == 2 and a[-1].page_end == 3 and len({r.doc_id for r in a}) == 1 and a[0].chunk_id == a[0].doc_id + "_chunk_0"
    assert all(r.meta["tenant"] == "acme" and r.meta["page_count"] == "3" and r.meta["extraction_method"] == "text" and r.meta["source_url"] == r.path and r.meta["ingested_at"].startswith("2024") for r in a)
    (b,) = (r for r in rows if r.f == "b.html")
    assert b.text == "Title of it A paragraph & more of it."
    kept = chain.records(out.drop("f")).collect()
    assert len(kept) == len(rows) - 4 and all(r.section is None and r.meta["chunk_id"] and "language" in r.meta for r in kept)


def test_chunks_are_the_ones_of_whole_texts(spark):
    texts = [(f"f{i}", GOOD * (1 + i % 40) + "Mehr ist nicht da.") for i in range(60)]
    df = spark.createDataFrame(texts, "path string, t string")
    made = chain.chunks(chain.read(df.select("path", F.encode("t", "utf-8").alias("content"))), most=60)
    want = chunking.token_chunks(df.select("path", T.clean(F.col("t")).alias("text")), "path", 60, 1)
    assert sorted((r.path, r.n, r.text, r.tokens) for r in made.collect()) == sorted((r.path, r.n, r.text, r.tokens) for r in want.collect())


def test_null_and_no_files(spark):
    df = spark.createDataFrame([("x", None), (None, bytearray(b"Enough of a text here."))], "path string, content binary")
    got = {r.path: (r.error, r.text) for r in chain.chunks(chain.read(df)).collect()}
    assert got == {"x": ("no content", None), None: (None, "Enough of a text here.")}
    assert chain.chunks(chain.read(df.limit(0))).count() == 0
