import math
import re
from collections import Counter

import numpy as np
import pytest

from proofline.llm import ranking as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def own_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """The definition, item by item and document by document."""
    bags = [(i, own_terms(t)) for i, t in docs]
    bags = [(i, len(t), Counter(t)) for i, t in bags if t]
    n, length = len(bags), sum(b[1] for b in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, size, bag in bags:
            m = 100 - 50 + (50 * size * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in set(own_terms(text)) if t in bag
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(documents, spark, docs, items, **more):
    df = spark.createDataFrame(items, "item_id long, text string")
    found = R.search(documents(*docs), df, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in found.collect()], key=str)


def corpus(rng, n):
    words = ["Alpha", "beta", "gämma", "ΔELTA", "x1", "漢字", "é", "İ", "the", "The"] + [f"w{i}" for i in range(60)]
    return [(i, " ,;-_\n".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(n)]


def test_terms():
    text = "AbC-ÉtÉ_x9 `{don't}` \x7f漢字\x00Ωm\xa0 "
    assert [t.decode() for t in R.terms(text)] == own_terms(text) == ["abc", "ÉtÉ", "x9", "don", "t", "漢字", "Ωm\xa0"]


def test_against_the_definition(documents, spark, rng):
    docs = corpus(rng, 400)
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (None, "alpha"), (900, None), (901, ""), (902, " .,"), (903, "the " * 20000)]
    items = [(i, " ".join(own_terms(docs[i * 9][1])[:8])) for i in range(20)] + [(3, "alpha beta beta"), (50, None), (51, ""), (52, "none-such"), (None, "the w1")]
    assert run(documents, spark, docs, items) == brute(docs, items)
    assert run(documents, spark, docs, items, k=3) == brute(docs, items, 3)


def test_ties_go_by_id(documents, spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(500, "other")]
    got = run(documents, spark, docs, [(1, "same"), (2, "other here")])
    assert got == brute(docs, [(1, "same"), (2, "other here")]) and sorted(r[2] for r in got if r[0] == 1) == [*range(1, 51)]


def test_blocks_stretches_and_tiles_change_nothing(documents, spark, rng, monkeypatch):
    docs = corpus(rng, 150)
    items = [(i, docs[i][1]) for i in range(12)]
    for name, value in (("BLOCK", 7), ("STRETCH", 5), ("ITEMS", 4), ("PARTS", 2)):
        monkeypatch.setattr(R, name, value)
    assert run(documents, spark, docs, items, k=5) == brute(docs, items, 5)


def test_best_keeps_what_is_level(rng):
    everything, best = [], R.Best(2, 3)
    best.most = 10
    for _ in range(30):
        scores = np.array([[rng.randint(0, 4) for _ in range(9)] for _ in range(2)])
        ids = np.array([rng.randint(0, 1000) for _ in range(9)])
        best.add(scores, ids, np.zeros(9, np.int64))
        everything += [(i, -scores[i, j], ids[j]) for i in range(2) for j in range(9) if scores[i, j]]
    item, score, _, ids = best.settle()
    want = [r for i in range(2) for r in sorted(e for e in everything if e[0] == i)[:3]]
    assert list(zip(item.tolist(), (-score).tolist(), ids.tolist(), strict=True)) == want


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty(documents, spark, docs, items):
    got = R.search(documents((0, "q")).limit(0) if not docs else documents(*docs), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_clashing_columns(documents, spark):
    items = spark.createDataFrame([(1, "ab", "x", 3)], "item_id long, text string, key string, score int")
    assert [tuple(r) for r in R.search(documents((4, "AB cd"), (5, "zz")), items).collect()] == brute([(4, "AB cd"), (5, "zz")], [(1, "ab")])
