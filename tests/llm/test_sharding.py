import bisect
import zlib

import pytest

from proofline.llm import sharding


def smallest(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, None
        room = middle
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize(("groups", "shards", "cells"), [(1, 4, 14), (5, 3, 14), (2000, 7, 2), (2000, 40, 3), (300, 40, 14)])
def test_capacity_is_the_smallest(spark, rng, monkeypatch, groups, shards, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    sizes = {rng.randrange(-(1 << 63), 1 << 63): rng.choice([1, 20, rng.randint(1, 3000)]) for _ in range(groups)}
    sizes[max(sizes)] += sum(sizes.values()) // 9  # one hot group
    capacity, firsts = sharding.minimax_cuts(spark.createDataFrame(list(sizes.items()), "key long, bytes long"), shards)
    keys = sorted(sizes)
    assert capacity == smallest([sizes[k] for k in keys], shards)
    filled = {}
    for k in keys:
        shard = bisect.bisect_right(firsts, k)
        filled[shard] = filled.get(shard, 0) + sizes[k]
    assert max(filled.values()) <= capacity and len(firsts) < shards


def test_report(documents):
    texts = [None, "", "é" * 10, "b", "b", "c" * 500, "d" * 90] + [f"text {i} " * (i % 9 + 1) for i in range(200)]
    rows = [(i % 150, t) for i, t in enumerate(texts)]
    got = sharding.report(documents(*rows), 8).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    shards = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    by_text = {}
    for r in got:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.report(documents(*rows).limit(0), 8).count() == 0


def test_slots_over_several_runs(documents, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 3)
    got = sharding.shard(documents(*[(i, f"{i}") for i in range(300)]), 4).collect()
    for n in range(4):
        own = [r.slot for r in got if r.shard == n]
        assert sorted(own) == list(range(len(own)))
