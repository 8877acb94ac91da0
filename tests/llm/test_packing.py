import numpy as np
import pytest

from proofline.llm import packing

RANKS = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}


def naive(lengths, size):
    """Best fit by looking at every row; of rows alike, the one used last."""
    rows, free, used = [], [], []
    for i, n in enumerate(lengths):
        fits = [k for k in range(len(rows)) if free[k] >= n]
        if fits:
            k = min(fits, key=lambda k: (free[k], -used[k]))
        else:
            rows.append([]), free.append(size), used.append(0)
            k = len(rows) - 1
        rows[k].append(i)
        free[k], used[k] = free[k] - n, i
    return rows


def test_best_fit_equals_looking_at_every_row(rng):
    for _ in range(200):
        size = rng.choice([1, 5, 16, 33, 100])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 60))), reverse=True)
        got = packing.best_fit(lengths, size)
        assert sorted(tuple(lengths[i] for i in r) for r in got) == sorted(tuple(lengths[i] for i in r) for r in naive(lengths, size))


@pytest.mark.parametrize("group", [4096, 2])
def test_packed_rows_hold_every_document(documents, group, tmp_path):
    texts = [None, "", "abc", "xabcab" * 30, "é", "a" * 64, "b" * 63] + [f"text {i}" * (i % 5) for i in range(40)]
    rows = list(enumerate(texts))
    packed = packing.pack(documents(*rows), RANKS, r"\w+|\s+|.", end=300, length=64, group=group)
    packing.write(packed, str(tmp_path / "out"))
    parts = {}
    for r in packed.sparkSession.read.parquet(str(tmp_path / "out")).collect():
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert (ids[r.n_tokens :] == 300).all()
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, {})[piece] = ids[a:b].tolist()
    token = {v: k for k, v in RANKS.items()}
    for i, text in rows:
        ids = [x for p in sorted(parts[i]) for x in parts[i][p]]
        assert ids.pop() == 300 and b"".join(token[x] for x in ids).decode() == (text or "")


def test_repeated_ids_and_empty_table(documents):
    rows = [(1, "abc"), (1, "abc"), (None, "abc")]
    packed = packing.pack(documents(*rows), RANKS, r"\w+", end=300, length=8).collect()
    assert sorted((d is None, d) for r in packed for d in r.doc_ids) == [(False, 1), (False, 1), (True, None)]
    assert packing.pack(documents(*rows).limit(0), RANKS, r"\w+", end=300).count() == 0


def test_groups_follow_the_bytes_and_repeats_are_spread(documents):
    rows = [(1, "abc" * 20)] * 2000 + [(i, "b" * 5000) for i in range(2, 20)]
    packed = packing.pack(documents(*rows).repartition(2), RANKS, r"\w+", end=300, length=64, group_bytes=10_000).collect()
    held = {}
    for r in packed:
        held[r.pack_group] = held.get(r.pack_group, 0) + r.n_tokens
    assert sum(len(r.doc_ids) for r in packed if 1 in r.doc_ids) >= 2000 and sum(r.doc_ids.count(1) for r in packed) == 2000
    assert sum(held.values()) == 2000 * 21 + 18 * 5001 and len(held) > 15 and max(held.values()) < sum(held.values()) / 4
