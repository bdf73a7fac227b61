import itertools
import re

import numpy as np
import pytest

from spindrift.llm import filteraudit

BITS = "ABCDE"


def fails(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller)
    return {n for n, t in zip(BITS, tests, strict=True) if t}


def brute(docs, labels):
    """Every order applied row by row."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    said = {}
    for d, q, x in labels:
        a = said.setdefault(d, [False, False])
        a[0], a[1] = a[0] or q == 1, a[1] or x == 1
    out = {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(fails(t or "", d is not None and d > first[t or ""]), said.get(d, [False, False]) if d is not None else [False, False]) for d, t, p in docs if (p or "") == part]
        gone = dict.fromkeys(BITS, 0)
        for order in itertools.permutations(BITS):
            left = rows
            for k, f in enumerate(order):
                now = [r for r in left if f in r[0]]
                failing = sum(f in r[0] for r in rows)
                left = [r for r in left if f not in r[0]]
                gone[f] += len(now)
                out[part, "".join(order), k + 1] = [len(left), len(now), failing - len(now), sum(r[0] == {f} for r in rows), sum(r[1][0] for r in now), sum(r[1][1] for r in now)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(gone[o[k - 1]])
    return out


DOCS = [
    (1, "Plain words " * 60, "en"), (2, " ".join(f"w{i}" for i in range(120)), "en"), (3, " ".join(f"w{i}" for i in range(120)), "de"), (3, " ".join(f"w{i}" for i in range(120)), "de"), (None, " ".join(f"w{i}" for i in range(120)), None),
    (4, None, "en"), (5, "", None), (6, "LOUD # TEXT", ""), (7, "LOUD # TEXT", "de"), (8, "a\x0bb\x0c\x1cc d " * 50, "en"), (None, None, "fr"), (9, "Ünï 😀 " * 40, "fr"), (9, "other", "fr"), (10, "x" * 300_000 + " y" * 500, "fr"), (-4, "LOUD # TEXT", "it"),
]
LABELS = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (7, 1, 1), (7, 1, 1), (99, 1, 1), (None, 1, 1), (8, None, 1), (9, 1, None)]


def test_against_every_order_row_by_row(spark):
    docs = spark.createDataFrame([(d, t, p, "k", 5, [1]) for d, t, p in DOCS], "doc_id long, text string, lang string, key string, n int, part array<int>")
    labels = spark.createDataFrame([(*r, "z") for r in LABELS], "doc_id long, quality int, toxic int, mask string")
    got = filteraudit.documents(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == brute(DOCS, LABELS) and len(got) == 600 * 5
    assert filteraudit.documents(docs.limit(0), labels.limit(0)).count() == 0
    assert filteraudit.documents(docs, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


@pytest.mark.parametrize("k", range(1, 7))
def test_swaps_visit_every_order_once(k):
    order, seen = list(range(k)), {tuple(range(k))}
    for i in filteraudit.transpositions(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(k)))


def test_shares_add_up():
    rng = np.random.default_rng(1)
    for k in (1, 2, 4, 5):
        cells = rng.integers(0, 50, (1 << k, 3))
        cells[:, 1:] = np.minimum(cells[:, 1:], cells[:, :1])
        want, orders = [0] * k, 0
        for order, steps in filteraudit.walk(cells, k):
            orders += 1
            assert steps[-1][0] == cells[0, 0] and sum(s[1] for s in steps) == cells[1:, 0].sum()
            for f, s in zip(order, steps, strict=True):
                want[f] += s[1]
        assert filteraudit.shapley(cells, k) == want and sum(want) == orders * cells[1:, 0].sum()
    with pytest.raises(ValueError):
        filteraudit.audit(None, "ABCDEFGHI")
