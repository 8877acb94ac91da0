import math
import re
from collections import Counter

import numpy as np
import pytest

from proofline.llm import ngram_lm, quality


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


TEXTS = [
    "", " ", "one", "a b c d e", "a b c d e a b c d e", "x x x x x x x x", "l\nl\n \nl \n\x1c\n\x1c", "é# *$ <b>|&%",
    "a b c d e f a b c d e g a b c d e", " ".join(f"w{i % 37}" for i in range(400)), "\x85 \xa0 a",
]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert quality.counts(text.encode()) == plain_counts(text)


def test_windows_of_many_kinds_stay_exact(rng):
    words = [f"w{rng.randrange(9000)}" for _ in range(12000)]
    words += words[500:510]
    assert quality.repeated_words([w.encode() for w in words]) == plain_counts(" ".join(words))[4]


def kneser_ney(texts, order):
    """Modified Kneser-Ney by the book: probabilities by recursion over plain dictionaries."""
    grams = Counter()
    for t in texts:
        line = chr(ngram_lm.MARK) * (order - 1) + " ".join(t.lower().split())
        for i in range(len(line) - order + 1):
            grams[line[i : i + order]] += 1
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, table in counts.items():
        n = [sum(c == i for c in table.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0 for i in (1, 2, 3)]
        discounts[k] = [r if 0 < r < i else 0.5 for i, r in zip((1, 2, 3), raw, strict=True)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        after = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        lost = {g: discounts[k][min(c, 3) - 1] for g, c in after.items()}
        return (after.get(gram, 0) - lost.get(gram, 0)) / total + sum(lost.values()) / total * p(gram[1:])

    return p


@pytest.mark.parametrize("rows", [6_000_000, 1])
def test_perplexity_equals_plain_kneser_ney(documents, monkeypatch, rows):
    monkeypatch.setattr(ngram_lm, "BROADCAST_ROWS", rows)
    taught = ["the cat sat on the mat and the dog sat on the log", "the mat and the cat and the rat sat with the dog today ok"]
    asked = ["a cat on a log is the cat of the dog and it sat on that", "###### ###### ###### ###### # # # # # #"]
    table = [(i, t) for i, t in enumerate(taught * 2 + asked)] + [(9, "das ist ein text auf deutsch und er ist gut so ja", "de")]
    teach = [t for _, t, *lang in table if not lang and quality.reads_as_prose(t.encode())]
    p = kneser_ney(teach, ngram_lm.ORDER)
    got = {r.doc_id: r.log_perplexity for r in quality.judge(documents(*table)).collect()}
    for i, text in enumerate(taught * 2 + asked[:1]):
        line = chr(ngram_lm.MARK) * (ngram_lm.ORDER - 1) + " ".join(text.split())
        logs = [math.log(p(line[k : k + ngram_lm.ORDER])) for k in range(len(line) - ngram_lm.ORDER + 1)]
        assert got[i] == pytest.approx(-sum(logs) / len(logs), rel=1e-5)
    assert got[5] > 5 and got[9] > 0


def test_bands_reject_symbols_and_keep_prose(documents, rng):
    words = "the and of river stone house walk bright under over slow green light water field".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 80)))) for i in range(150)]
    rows += [(1000 + i, " ".join(rng.choice(words) + rng.choice(["###", "$$$", "%%%"]) for _ in range(60))) for i in range(10)]
    rows += [(2000, " ".join("".join(rng.choice("zqxjvwk") for _ in range(5)) for _ in range(80)))]
    df = documents(*rows)
    kept = {r.doc_id for r in quality.keep(df).collect()}
    assert kept == set(range(150)) and quality.keep(df).columns == df.columns


def test_edges(documents):
    rows = [(1, None), (None, "", None), (3, "a b c d e f g h i j k", None), (3, "a b c d e f g h i j k", None), (4, "x " * 3000)]
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.report(documents(*rows)).collect()}
    assert got == {(1, 0, True, False), (None, 0, True, False), (3, 11, False, True), (4, 3000, True, False)}
    assert quality.report(documents(*rows).limit(0)).count() == 0


def test_copies_do_not_close_the_band(documents, rng):
    words = "the and of river stone house walk bright under over slow green light water field".split()
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 80)))
    own, copied = [(i, some()) for i in range(60)], some()
    junk = [(2000, " ".join("".join(rng.choice("zqxjvwk") for _ in range(5)) for _ in range(80)))]
    rows = own + [(100 + i, copied) for i in range(240)] + junk  # one text holds 80% of the language
    assert {r.doc_id for r in quality.keep(documents(*rows)).collect()} == {*range(60), *range(100, 340)}
    copies = quality.judge(documents(*rows)).filter("doc_id BETWEEN 100 AND 339")
    assert copies.select("log_perplexity", "kept").distinct().count() == 1


def test_without_a_band_plain_rules_decide(documents):
    marked = " ".join(f"word{i} #" for i in range(30))  # too many symbols to teach, and no rule against it
    got = {r.doc_id: r.kept for r in quality.report(documents((1, marked, "xx"), (2, "a b", "xx"))).collect()}
    assert got == {1: True, 2: False}


def test_ngrams_of_one_beginning_do_not_share_a_slot():
    """Hashes of n-grams that differ in their last letter differ in their last bits; each is found near its slot."""
    codes = np.array([x for last in range(97, 2097) for x in (98, 99, 100, last)], dtype=np.uint64)
    seeds = np.full(len(codes), ngram_lm.seed("en"), dtype=np.uint64)
    hashes = ngram_lm.rolled(codes, seeds[:2000], np.arange(2000) * 4, 4)
    model = ngram_lm.Arrays(4, {4: np.sort(hashes)}, {4: np.zeros(2000, np.float32)}, {4: np.zeros(2000, np.float32)})
    looks = 0

    class Counted(np.ndarray):
        def __getitem__(self, at):
            nonlocal looks
            looks += np.size(at)
            return np.asarray(self)[at]

    model.open(4)
    model.slots[4] = (model.slots[4][0].view(Counted), *model.slots[4][1:])
    assert model.find(4, hashes)[1].all() and looks < 5 * 2000
    missing = ngram_lm.rolled(codes + np.uint64(5000), seeds[:2000], np.arange(2000) * 4, 4)
    assert not model.find(4, missing)[1].any()


def test_scores_with_gaps_in_the_model():
    """Lengths without an entry, entries without a probability and without a weight: as worked out by hand."""
    body = ngram_lm.windows([b"ab"], ["en"], 2)
    one = ngram_lm.rolled(body.codes, body.seeds, body.places + 1, 1)
    two = ngram_lm.rolled(body.codes, body.seeds, body.places, 2)
    by = np.argsort(one)
    model = ngram_lm.Arrays(
        2, {1: one[by], 2: two[:1]}, {1: np.array([-1.0, -2.0], np.float32)[by], 2: np.array([-0.5], np.float32)},
        {1: np.array([-0.25, np.nan], np.float32)[by], 2: np.full(1, np.nan, np.float32)},
    )
    # "^a" is known; "ab" is not: the weight of "a" and the probability of "b"
    assert model.score(body).tolist() == [-0.5, -2.25]
    none = ngram_lm.Arrays(2, *({k: np.empty(0, t) for k in (1, 2)} for t in (np.uint64, np.float32, np.float32)))
    assert none.score(body).tolist() == [ngram_lm.UNKNOWN] * 2


def test_model_tables_are_read_not_worked_out_again(spark, documents):
    """What is counted and then collected is stored: no join runs a second time."""
    text = "some plain words that make a text which is long enough to be counted by this model"
    model = ngram_lm.train(documents((1, text), (2, text + " again", "fr")).select("text", "lang"))
    for rows in model.values():
        assert "Join" not in rows._jdf.queryExecution().toString()
    found = ngram_lm.arrays(model)
    assert {k: len(found.hashes[k]) for k in model} == {k: t.count() for k, t in model.items()}


def test_all_orders_share_their_steps(documents, monkeypatch):
    """Every stored table costs the driver memory, so their number stays near that of the orders; the tables are whole."""
    labels = []
    keep = ngram_lm.stored
    monkeypatch.setattr(ngram_lm, "stored", lambda df, label: labels.append(label) or keep(df, label))
    texts = [("ab a", "en"), ("ab b 😀", "en"), ("a", None)]
    model = ngram_lm.train(documents(*[(i, t, lang) for i, (t, lang) in enumerate(texts)]).select("text", "lang"), 3)
    assert len(labels) <= 3 + 5
    grams = {(lang, line[i : i + 3]) for t, lang in texts for line in ["\2\2" + t] for i in range(len(t))}
    for k in (3, 2, 1):
        kinds = {(lang, g[3 - k :]) for lang, g in grams}
        contexts = {(lang, g[3 - j :][:-1]) for lang, g in grams for j in (2, 3) if j - 1 == k}
        rows = model[k].collect()
        assert {(r.lang, r.gram) for r in rows if r.p is not None} == kinds and len(rows) == len(kinds | contexts)
        assert {(r.lang, r.gram) for r in rows if r.backoff is not None} == contexts
