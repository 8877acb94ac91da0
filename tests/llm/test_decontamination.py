import random

import numpy as np
import pytest

from proofline.llm import decontamination as D


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    syllables = "an ter ing ou rel sta ti me le de con ver si ly ab".split()
    rare = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    usual = "the of and to a in is it that was".split()
    some = lambda n: [rng.choice(usual) if rng.random() < 0.5 else rare() for _ in range(n)]
    items = [(i, some(rng.randint(15, 60))) for i in range(60)]
    docs, leaks = [], set()
    for i in range(300):
        words = some(rng.randint(5, 300))
        if i % 10 == 0:
            n, item = items[i // 10]
            item = list(item)
            if i % 20 == 0:  # a paraphrase: one word in seven goes or changes
                item = [w if rng.random() > 0.07 else rare() for w in item if rng.random() > 0.07]
            at = rng.randint(0, len(words))
            words[at:at] = item
            leaks.add((i, n))
        docs.append((i, " ".join(words).capitalize() + "."))
    return docs, [(i, " ".join(w)) for i, w in items], leaks


def test_links_are_those_planted(spark, documents, corpus):
    docs, items, leaks = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.find(documents(*docs), benchmark).collect()}
    assert set(got) == leaks
    words = dict(items)
    for (doc, item), r in got.items():
        own, inside = D.words_of(words[item].encode()), D.words_of(docs[doc][1].encode())[r.first_word : r.last_word]
        assert r.common_words == common(own, inside) and r.item_words == len(own)
    small = {(r.doc_id, r.item_id) for r in D.find(documents(*docs), benchmark, size=16).collect()}
    assert small == leaks  # several blocks
    left = D.clean(documents(*docs), benchmark)
    assert sorted(r.doc_id for r in left.collect()) == sorted({i for i, _ in docs} - {d for d, _ in leaks})
    assert left.columns == documents(*docs).columns


def test_weights_are_document_frequencies(documents):
    docs = [(1, "a b b"), (2, "A, c"), (3, None), (4, "")]
    got = D.weights(documents(*docs))
    for word, df in (("a", 2), ("b", 1), ("c", 1), ("zz", 0)):
        assert got[D.buckets_of([word.encode()])[0]] == pytest.approx(max(np.log(3 / (df + 1)), 0.01), rel=1e-6)


def test_svd_spans_the_rows(spark, corpus):
    _, items, _ = corpus
    idf = np.full(D.BUCKETS, 1.5, dtype=np.float32)
    rows = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(items)], "row long, text string").repartition(4)
    terms, v = D.randomised_svd(rows, idf, rank=80)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    place = {int(t): i for i, t in enumerate(terms)}
    matrix = np.zeros((len(items), len(terms)))
    for n, (_, text) in enumerate(items):
        t, value = D._row(D.words_of(text.encode()), idf)
        matrix[n, [place[int(x)] for x in t]] = value
    assert np.allclose(matrix @ v @ v.T, matrix, atol=1e-3)  # rank covers all items
    low_terms, low = D.randomised_svd(rows, idf, rank=20, rounds=3)
    kept = np.linalg.norm(matrix @ low) ** 2
    assert (low_terms == terms).all() and kept > 0.95 * (np.linalg.svd(matrix, compute_uv=False)[: low.shape[1]] ** 2).sum()


def test_edges(spark, documents):
    schema = "item_id long, text string"
    docs = documents((1, None), (2, ""), (None, "one two three four five six"), (3, "one two three four five six"), (3, "one two three four five six"))
    items = spark.createDataFrame([(7, "One two, three four five six!"), (8, None), (9, ""), (9, "?!"), (7, "One two, three four five six!")], schema)
    got = sorted((r.doc_id or 0, r.item_id) for r in D.find(docs, items).collect())
    assert got == [(0, 7)] * 2 + [(3, 7)] * 4
    assert D.clean(docs, items).count() == 2
    assert D.find(docs, items.limit(0)).count() == 0 and D.clean(docs, items.limit(0)).count() == 5
    assert D.find(docs.limit(0), items).count() == 0


def test_large_benchmark_finds_every_verbatim_copy(spark, documents):
    rng = random.Random(8)
    syllables = "an ter ing ou rel sta ti me le de con ver si ly ab".split()
    kinds = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(1500)]
    some = lambda n: [rng.choice(kinds) for _ in range(n)]
    items = [(i, some(rng.randint(15, 40))) for i in range(2100)]
    docs = [(i, " ".join(some(40) + w + some(40))) for i, w in items] + [(5000 + i, " ".join(some(100))) for i in range(50)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find(documents(*docs), benchmark).select("doc_id", "item_id").collect()}
    assert got == {(i, i) for i, _ in items}


def sisters(pairs):
    """Items of 30 words in pairs that share 12 of them, each in an order of its own."""
    rng = random.Random(21)
    items = []
    for p in range(pairs):
        kinds = [f"p{p}w{i}" for i in range(48)]
        items += [(2 * p, rng.sample(kinds[:30], 30)), (2 * p + 1, rng.sample(kinds[18:], 30))]
    return items


def test_passages_are_found_by_words_that_share_items(spark, documents):
    """Documents hold an item's words in their order, but three words of its sister to two of its own: too few for its own cosine."""
    rng = random.Random(22)
    items, docs, mixed = sisters(16), [], {(i, 2 * i) for i in range(8)}
    for i, item in mixed:
        own, others = items[item][1], [w for w in items[item + 1][1] if w not in items[item][1]]
        others = [w for _ in range(3) for w in rng.sample(others, len(others))]
        words = [w for a, b in zip(own[::2], own[1::2], strict=True) for w in (a, others.pop(), others.pop(), b, others.pop())]
        docs.append((i, " ".join([f"d{i}x{n}" for n in range(60)] + words + [f"d{i}y{n}" for n in range(60)])))
    docs += [(100 + i, " ".join(f"u{rng.randrange(500)}" for _ in range(120))) for i in range(100)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    block = next(D.blocks(documents(*docs), benchmark))
    assert 0 < block.vectors.shape[1] < len(items)
    for i, text in docs[:8]:
        split, own = D.buckets_of(D.words_of(text.encode())), D._row(block.words[dict(mixed)[i]], block.idf)
        own = dict(zip(own[0].tolist(), own[1].tolist(), strict=True))
        weight = block.idf[split].astype(float)
        each = np.array([own.get(b, 0) for b in split.tolist()]) * weight
        assert max(each[a : a + 30].sum() / np.linalg.norm(weight[a : a + 30]) for a in range(len(split))) < D.COSINE
    got = {(r.doc_id, r.item_id): r.cosine for r in D.find(documents(*docs), benchmark).collect()}
    assert set(got) == mixed and min(got.values()) >= D.COSINE
    assert {r.doc_id for r in D.clean(documents(*docs), benchmark).collect()} == {i for i, _ in docs} - {i for i, _ in mixed}


def test_svd_has_the_first_directions_of_all_rows(spark):
    items = sisters(60)
    idf = np.full(D.BUCKETS, 1.5, dtype=np.float32)
    rows = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "row long, text string").repartition(3)
    terms, v = D.randomised_svd(rows, idf, rank=60)
    matrix = np.zeros((len(items), len(terms)))
    for n, w in items:
        t, value = D._row([x.encode() for x in w], idf)
        matrix[n, np.searchsorted(terms, t)] = value
    best = (np.linalg.svd(matrix, compute_uv=False)[:60] ** 2).sum()
    assert v.shape[1] == 60 and 0.99 * best < np.linalg.norm(matrix @ v) ** 2 < 1.001 * best
