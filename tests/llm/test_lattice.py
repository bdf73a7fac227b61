import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import lattice, registry

SF = "/root/testdata/sf0.001"
LOG = lambda v: np.log(v.prior)


def segmentations(word, vocab):
    """Every way to write a word (its mark included) as pieces or, for a character that is no piece, its bytes."""
    if not word:
        yield ()
        return
    known = {p: i for i, p in enumerate(vocab.pieces)}
    for n in range(1, len(word) + 1):
        i = known.get(word[:n])
        if i is not None:
            yield from ((i, *rest) for rest in segmentations(word[n:], vocab))
        elif n == 1:
            spelt = tuple(vocab.first_byte + b for b in word[0].replace("\ue000", "▁").encode())
            yield from ((*spelt, *rest) for rest in segmentations(word[1:], vocab))


def brute(word, vocab, log_weight):
    return sum(math.exp(sum(log_weight[i] for i in s)) for s in segmentations("▁" + word.replace("▁", "\ue000"), vocab))


WORDS = ["a", "the", "there", "tionment", "éçmentelle", "x", "😀x", "▁", "▁a▁", "naïve", "zzzzzz", "\x00a", "\x1cb", "don't", "<0x41>", "</s>"]


def test_marginals_sum_over_all_segmentations():
    vocab = lattice.vocabulary()
    assert abs(vocab.prior.sum() - 1) < 1e-12 and len(vocab.prior) == vocab.end + 1
    got = lattice.marginals([w.encode() for w in WORDS], vocab, LOG(vocab))
    for w, x in zip(WORDS, got, strict=True):
        assert math.isclose(x, math.log(brute(w, vocab, LOG(vocab))), rel_tol=1e-10), w
    alone = [lattice.marginals([w.encode()], vocab, LOG(vocab))[0] for w in WORDS]
    assert np.allclose(got, alone, rtol=1e-12)


def test_uses_are_expectations():
    vocab = lattice.vocabulary()
    w = LOG(vocab)
    words, counts = ["there", "tion", "😀x"], np.array([3, 1, 2])
    want = np.zeros(vocab.end + 1)
    for word, n in zip(words, counts, strict=True):
        whole = brute(word, vocab, w)
        for s in segmentations("▁" + word, vocab):
            for i in s:
                want[i] += n * math.exp(sum(w[j] for j in s)) / whole
    assert np.allclose(lattice.uses([x.encode() for x in words], counts, vocab, w), want, rtol=1e-9, atol=1e-15)


def test_long_words():
    """A word beyond the batched recursion gives what the batched one gives, and a word of 300,000 characters ends."""
    vocab = lattice.vocabulary()
    word = ("therening" * 40)[: lattice.LONG + 40].encode()
    a = lattice.arcs([word, b"a"], vocab, LOG(vocab))
    assert math.isclose(lattice._recursion(a)[a.last[0]], lattice.marginals([word], vocab, LOG(vocab))[0], rel_tol=1e-12)
    both = lattice._recursion(a, backward=True)[a.first[0]]
    assert math.isclose(both, lattice.marginals([word], vocab, LOG(vocab))[0], rel_tol=1e-12)
    assert lattice.marginals([b"thex" * 75_000], vocab, LOG(vocab))[0] < -100_000


def base_scores(docs):
    """n_tokens, n_known, train_tokens and base_score of documents (doc_id, text) in plain Python."""
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    c = Counter(w for (_, t), o in zip(docs, out, strict=True) if not o for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, o, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for (d, t), o in zip(docs, out, strict=True)], c


def weights(counts, vocab, rounds=lattice.ROUNDS):
    w = LOG(vocab)
    words = [x for x in counts if x is not None]
    for _ in range(rounds):
        used = np.zeros(vocab.end + 1)
        for x in words:
            used += lattice.uses([x.encode()], np.array([counts[x]]), vocab, w)
        used[vocab.end] = counts[None]
        w = np.log((used + lattice.PRIOR * vocab.prior) / (used.sum() + lattice.PRIOR))
    return w


HELD = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
DOCS = [
    (1, "The cat sat on the mat"), (2, None), (3, ""), (4, " \t\n"), (5, "the THE tHe\x0bthe\x1cthe é É"), (5, "the THE tHe\x0bthe\x1cthe é É"), (None, "null id here"), (None, None), (HELD[0], "only here heldword heldword the"),
    (HELD[1], "heldword " * 300), (HELD[2], None), (6, "</s> end ▁ 😀 " * 3), (7, "z" * 5000), (8, "a퟿b \x00 \x85  "),
]


@pytest.mark.parametrize("hot", [0, 3, lattice.HOT])
def test_scores_against_brute_force(spark, hot):
    df = spark.createDataFrame([(d, t, "x", 7, [1], 1.0) for d, t in DOCS], "doc_id long, text string, word string, total long, rest array<int>, base double")
    got = sorted(lattice.score(df, hot=hot).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want, counts = base_scores(DOCS)
    vocab = lattice.vocabulary()
    w = weights(counts, vocab)
    lat = [sum(lattice.marginals([x.encode()], vocab, w)[0] for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) + w[vocab.end] for _, t in DOCS]
    want = sorted(((*r, x / math.log(10)) for r, x in zip(want, lat, strict=True)), key=lambda r: (str(r[0]), r[2], r[5]))
    for g, x in zip(got, want, strict=True):
        assert tuple(g)[:5] == x[:5]
        assert math.isclose(g.base_score, x[5], rel_tol=1e-8) and math.isclose(g.score, x[6], rel_tol=1e-8)


def test_nothing_to_train_on(spark):
    schema = "doc_id long, text string"
    assert lattice.score(spark.createDataFrame([], schema)).collect() == []
    r = lattice.score(spark.createDataFrame([(HELD[0], "some words")], schema)).collect()
    assert (r[0].n_tokens, r[0].n_known, r[0].train_tokens, r[0].base_score) == (3, 0, 0, 0.0) and r[0].score < -3


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in registry.QUERIES["op13_lattice"](spark, SF).collect()}
    want, _ = base_scores(docs)
    for d, out, n, known, total, base in want:
        g = got[d]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (out, n, known, total) and math.isclose(g.base_score, base, rel_tol=1e-9)
    # texts unlike the corpus are less likely, letter by letter, than its held-out texts
    per = [g.score / max(len(t or ""), 1) for d, t in docs if (g := got[d]).held_out and g.n_tokens > 50]
    vocab = lattice.vocabulary()
    assert per and max(per) < 0 and np.median(per) > lattice.marginals([b"qzxkvwjpqhgfxzzq"], vocab, LOG(vocab))[0] / math.log(10) / 16
