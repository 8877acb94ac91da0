import re

import numpy as np
import pytest
import xxhash

from proofline.llm import simhash
from proofline.llm.components import components


def by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


TEXTS = ["", None, "One", "one two", "A b C", "the the the the", "x\x1cy z\x85w ÀÉ ñ", "same words in a row " * 400, " \t\r\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == by_hand(text)


def test_components_equal_union_find(spark, rng):
    for size, count in ((2, 1), (30, 20), (60, 90)):
        links = [(rng.randrange(-size, size), rng.randrange(-size, size)) for _ in range(count)]
        links += [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        nodes = {x for link in links for x in link}
        assert {n: got.get(n, n) for n in nodes} == groups(nodes, links)


@pytest.mark.parametrize("limit", [4096, 12, 3])
def test_links_join_the_same_parts_as_all_pairs(spark, rng, limit):
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(20):
            near = base
            for _ in range(rng.randint(0, 5)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    dense = rng.getrandbits(64)
    prints |= {dense ^ i for i in range(512)}  # a list that stays long at every level
    every = np.array(sorted(prints), dtype=np.uint64)
    signed = every.view(np.int64).tolist()
    pairs = [(signed[i], signed[j]) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every[i] ^ every) <= 3).tolist() if j > i]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit=limit)
    got = {r.node: r.root for r in components(links).collect()}
    assert {x: got.get(x, x) for x in signed} == groups(signed, pairs)
    if limit == 4096:
        assert links.count() < 30 * len(signed)  # links that join parts, not all pairs


def test_report(documents):
    base = "a text of some words that is long enough to be told from any other one in this table of ours here"
    rows = [(5, base), (3, base), (9, base + " "), (4, base.upper()), (7, None), (8, ""), (8, ""), (None, base), (2, "quite another text altogether now")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.report(documents(*rows)).collect())
    same = f"{by_hand(base):016x}"
    assert [g for g in got if g[1] == same] == [(-1, same, 3), (3, same, 3), (4, same, 3), (5, same, 3), (9, same, 3)]
    assert [g for g in got if g[1] == "0" * 16] == [(7, "0" * 16, 7), (8, "0" * 16, 7), (8, "0" * 16, 7)]
    kept = simhash.one_of_each(documents(*rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7] and kept.columns == documents(*rows).columns
    assert simhash.report(documents(*rows).limit(0)).count() == 0


def test_ids_missing_in_a_whole_group(documents):
    got = simhash.report(documents((None, "a b c d"), (None, "a b c d"))).collect()
    assert [r.component_id for r in got] == [None, None]
    assert simhash.one_of_each(documents((None, "a b c d"), (None, "a b c d"))).count() == 1


def test_one_row_of_each_group_whatever_its_id(documents):
    a, b, c = "stone river light water", "green house under walk", "slow field bright over"
    rows = [(1, a), (1, b), (2, b), (None, c), (None, "other words than those"), (3, a)]
    kept = simhash.one_of_each(documents(*rows)).collect()
    assert sorted(r.text for r in kept) == sorted({a, b, c, "other words than those"})
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 1]
