import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import langid


def brute(text):
    v = langid._vectors()[0].astype(int)
    s = [langid._symbols()[ord(c)] for c in (text or "").lower()]
    s = [x for i, x in enumerate([0, *s, 0]) if i == 0 or x or ([0, *s, 0])[i - 1]]
    out = np.zeros(langid.DIM)
    if any(s):
        for a, b, c in zip(s, s[1:], s[2:]):
            out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


TEXTS = ["Hello  World", "a", "ééß Ünder 12 z", "", None, "12 !!", "x" * 50, "𝔘nd so"]


def test_bundles_match_definition():
    got, lettered = langid.bundles(TEXTS)
    assert lettered.tolist() == [True, True, True, False, False, False, True, True]
    assert np.array_equal(got, np.array([brute(t) for t in TEXTS]))
    text = "Some words, in blocks; 99 cut  anywhere"
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    for block in (1, 2, 5):
        assert np.array_equal(np.sort(np.concatenate(list(langid.grams(text, block)))), whole)


def test_training_is_the_sum_over_all_rows(spark):
    rows = [(i, t, ["x", "y"][i % 2], 1) for i, t in enumerate(TEXTS)] + [(99, "no language", None, 1), (None, "null id", "x", 1)]
    known = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, at int"))
    assert known.langs == ("x", "y")
    for lang, v in zip(known.langs, known.vectors, strict=True):
        assert np.array_equal(v, sum(brute(r[1]) for r in rows if r[2] == lang))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "99", "y")], "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs)).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got] == [(i, "und", 0.0) for i in (1, 2, 3)]
    empty = docs.limit(0)
    assert langid.train(empty).langs == () and langid.predict(empty, langid.train(docs)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    known = langid.train(docs.where("not held_out"))
    got = langid.predict(docs.where("held_out"), known, ["lang"]).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_classify_against_the_definition(spark):
    """Language and cosine of each text, vector by vector; ties go to the first name, repeated rows get equal results."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der Hund und die Katze", "de"), ("der Hund und die Katze", "da")])]
    known = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert known.langs == ("da", "de", "en", "fr")
    texts = ["the dog", "le chien!", "Katze und Hund", "мир труд май", "the " * 400_000 + "end", "the dog", None, "7"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known).collect()
    own = {lang: brute(t) for _, t, lang in rows}
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for r in got:
        t = texts[r.doc_id]
        if r.doc_id == 4:  # long: the counts of its grams are known
            t = "the " * 1000
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        each = {k: cosine(brute(t), v) for k, v in own.items()}
        best = max(sorted(each), key=lambda k: each[k])
        assert r.lang_pred == best and abs(r.score - max(0.0, each[best])) < (1e-3 if r.doc_id == 4 else 1e-6)
    assert got[0][1:] == got[5][1:] and got[2].lang_pred == "da"


def test_scripts_share_no_symbol():
    s = langid._symbols()
    letters = [c for c in range(0x0FFD) if s[c]]
    assert len({s[c] for c in letters}) == len(letters) and len({langid._vectors()[0][s[c]].tobytes() for c in letters}) == len(letters)
