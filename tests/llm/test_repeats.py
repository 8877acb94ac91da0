import hashlib

import pytest

from proofline.llm import repeats


def by_hand(docs, keep_first=False):
    """Every window of every document, compared by its bytes."""
    size, seen, first = repeats.LENGTH, {}, {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    data = [(t or "").encode() for _, t in docs]
    for i in order:
        for s in range(len(data[i]) - size + 1):
            window = data[i][s : s + size]
            seen[window] = seen.get(window, 0) + 1
            first.setdefault(window, (i, s))
    out = []
    for i, (doc, _) in enumerate(docs):
        gone = bytearray(len(data[i]))
        for s in range(len(data[i]) - size + 1):
            window = data[i][s : s + size]
            if first[window] != (i, s) if keep_first else seen[window] > 1:
                gone[s : s + size] = b"\1" * size
        kept = bytes(b for b, g in zip(data[i], gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((doc, len(data[i]), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    import random

    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    parts = [some(n) for n in (380, 390, 398, 399, 400, 401, 420, 900)]
    docs = []
    for i in range(70):
        text = "".join(some(rng.choice([0, 1, 30, 500])) + rng.choice(parts) for _ in range(rng.randint(0, 4)))
        docs.append((i, text + some(rng.randint(0, 300))))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "a" * 1500), (105, "ab" * 700 + "x"), (106, "x" * 399)]
    long = list(some(3000))
    docs.append((107, "".join(long)))
    for i in range(6):  # near copies
        near = list(long)
        for _ in range(3):
            near[rng.randrange(len(near))] = "Z"
        docs.append((110 + i, "".join(near)))
    return docs


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limit", [2048, 2])
def test_equals_comparing_all_windows(documents, texts, keep_first, limit, monkeypatch):
    monkeypatch.setattr(repeats.repeats, "__defaults__", (False, "doc_id", "text", limit))
    got = sorted(map(tuple, repeats.report(documents(*texts), keep_first).collect()), key=str)
    assert got == by_hand(texts, keep_first)


def test_same_id_and_missing_id(documents):
    text = "".join(chr(97 + i * i % 23) for i in range(1000))
    rows = [(1, text), (1, text), (None, text[:450])]
    got = sorted(map(tuple, repeats.report(documents(*rows)).collect()), key=str)
    assert got == by_hand(rows)
    assert repeats.report(documents(*rows).limit(0)).count() == 0


def test_remaining_bytes_of_the_operator(documents):
    text = "".join(chr(97 + i * 7 % 26 if i % 3 else 97 + i * i % 25) for i in range(600))
    own = {r.kept for r in repeats.cut(repeats.repeats(documents((1, "X" + text), (2, text + "Y"), (3, "z" * 10)))).collect()}
    assert own == {b"X", b"Y"}


def test_texts_longer_than_one_stretch(documents):
    import random

    rng = random.Random(3)
    some = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    passage = some(600)
    long = some(3_999_700) + "1" + passage + "2" + some(400_000) + "3" + passage + "4" + some(300)
    rows = [(1, long), (2, "5" + passage + "6"), (3, "7" + passage[:399] + "8")]
    got = {r.doc_id: r for r in repeats.report(documents(*rows)).collect()}
    assert {i: (r.n_removed, r.n_spans) for i, r in got.items()} == {1: (1200, 2), 2: (600, 1), 3: (0, 0)}
    assert got[1].kept_sha256 == hashlib.sha256(long.replace(passage, "").encode()).hexdigest()
    first = {r.doc_id: r.n_removed for r in repeats.report(documents(*rows), keep_first=True).collect()}
    assert first == {1: 600, 2: 600, 3: 0}


def test_near_copies_beyond_the_limit_are_halved(documents, monkeypatch):
    import random

    rng = random.Random(6)
    base = rng.choices("abcdefghijklmnop", k=900)
    rows = []
    for i in range(60):
        near = list(base)
        near[rng.randrange(900)] = "Z"
        rows.append((i, "".join(near)))
    monkeypatch.setattr(repeats.repeats, "__defaults__", (False, "doc_id", "text", 8))
    for keep_first in (False, True):
        assert sorted(map(tuple, repeats.report(documents(*rows), keep_first).collect()), key=str) == by_hand(rows, keep_first)


def test_planted_passages_show_in_the_bytes_removed(documents, rng):
    """Passages of over 50 words in two documents each: those of 400 bytes go, shorter ones and clean documents stay whole."""
    words = lambda n, size: " ".join("".join(rng.choices("abcdefghijklmnop", k=size)) for _ in range(n))
    rows, long = [], set()
    for i in range(12):
        passage = words(52, 8 if i % 2 else 5)  # 467 and 311 bytes
        rows += [(doc, f"{words(40, 7)} {passage} {words(30, 7)}") for doc in (2 * i, 2 * i + 1)]
        long |= {2 * i, 2 * i + 1} if i % 2 else set()
    rows += [(100 + i, words(rng.randint(1, 200), 7)) for i in range(24)]
    got = repeats.report(documents(*rows)).collect()
    assert {r.doc_id for r in got if r.n_removed} == long == {r.doc_id for r in got if r.n_spans == 1}
    assert all(r.n_removed >= 467 for r in got if r.doc_id in long)
    assert sorted(map(tuple, got), key=str) == by_hand(rows)
