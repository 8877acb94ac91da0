"""Synchronisation status told by the words on a screen."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.similarity import WordTable, best_window_ratios
from proofline.functions.text import fold_text, has_text, let

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_LETTERS = 500_000
#: Letters beyond which a text is scored without a search for pieces of keywords before.
LONG_TEXT = 500


def needed_score(keyword: str) -> int:
    """A short single word is one slip away from harmless words: it must match exactly."""
    short = " " not in keyword and len(keyword) <= K.SHORT_KEYWORD_LENGTH
    return K.SHORT_KEYWORD_THRESHOLD if short else K.KEYWORD_THRESHOLD


def _whole_word(keyword: str) -> str:
    return r"(?<!\w)" + re.escape(keyword) + r"(?!\w)"


def exact_keyword(folded: Column, keywords: Sequence[str]) -> Column:
    """The keyword standing in the text as a whole word, or null.

    A keyword with a lower bar has the larger margin and wins; among equal
    margins the later one in the list wins.
    """
    ranked = sorted(
        (k for k in enumerate(keywords) if k[1]), key=lambda k: (needed_score(k[1]), -k[0])
    )
    found = F.lit(None).cast("string")
    for _, keyword in reversed(ranked):
        # The plain search spares most texts the pattern.
        here = folded.contains(keyword) & folded.rlike(_whole_word(keyword))
        found = F.when(here, keyword).otherwise(found)
    return found


def _scorer(keywords: Sequence[str]) -> Callable[[Sequence[str]], dict[str, tuple[str | None, float]]]:
    """Gives for distinct texts the best keyword, exact or close enough, and its score."""
    ranked = [(k, needed_score(k), re.compile(_whole_word(k))) for k in keywords if k]
    exact_bar = K.SHORT_KEYWORD_THRESHOLD

    def score(texts: list[str]) -> list[tuple[str | None, float]]:
        table = WordTable(texts)
        chosen = np.full(len(texts), -1)
        top, margin = np.zeros(len(texts)), np.zeros(len(texts))
        for number, (keyword, needed, whole) in enumerate(ranked):
            exact = np.array([keyword in t and whole.search(t) is not None for t in texts])
            scores = np.where(exact, 100.0, 0.0)
            if needed < exact_bar:  # otherwise only the whole word reaches its bar
                scores = np.maximum(scores, best_window_ratios(keyword, table, needed))
            take = (scores >= needed) & ((chosen < 0) | (scores - needed >= margin))
            chosen[take], top[take], margin[take] = number, scores[take], scores[take] - needed
        return [(ranked[c][0] if c >= 0 else None, float(s)) for c, s in zip(chosen, top)]

    def search(texts: Sequence[str]) -> dict[str, tuple[str | None, float]]:
        found: dict[str, tuple[str | None, float]] = {}
        part, letters = [], 0
        # Texts are scored together, a bounded number of letters at a time.
        for text in texts:
            part.append(text)
            letters += len(text)
            if letters > CHUNK_LETTERS:
                found.update(zip(part, score(part)))
                part, letters = [], 0
        found.update(zip(part, score(part)))
        return found

    return search


def fuzzy_keyword(folded: Column, keywords: Sequence[str]) -> Column:
    """struct(keyword, score): the best keyword, exact or close enough."""
    search = _scorer(keywords)

    @F.pandas_udf("keyword string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        found = search(texts.dropna().unique())
        return pd.DataFrame([found.get(t, (None, 0.0)) for t in texts], columns=["keyword", "score"])

    return best(folded)


def possible_keyword(folded: Column, keyword: str) -> Column:
    """Whether a run of words in the text may reach the bar of a keyword: it holds the word, or enough of its letter triples.

    A run of n letters at score s shares s * (m + n) / 2 letters with the m of the keyword. A letter of the keyword
    that goes breaks three of its triples, one put in breaks two, so at least so many of them stand in the text.
    """
    whole = folded.contains(keyword)
    needed = needed_score(keyword)
    if needed >= K.SHORT_KEYWORD_THRESHOLD:
        return whole
    size, lost = len(keyword), 1 - needed / 100.0
    # gone + put in <= lost * (2 * size - gone + put in): the worst is all of one kind
    broken = int(max(3 * 2 * lost * size / (1 + lost), 2 * 2 * lost * size / (1 - lost)) + 1e-9)
    triples = [keyword[i : i + 3] for i in range(size - 2)]
    if len(triples) - broken < 1:
        return F.lit(True)
    held = reduce(lambda a, b: a + b, [F.when(folded.contains(t), 1).otherwise(0) for t in triples])
    return whole | (held >= len(triples) - broken)


def _near_words(folded: Column, error: Sequence[str], success: Sequence[str]) -> Column:
    """The best error and success word of a text, as far as they can matter, and what its fixed words say.

    The text is folded and the fixed words are sought once, in the JVM. What they settle is not scored, nor are texts
    that can reach no keyword's bar, and words of success are sought only where no error word was found and nothing is
    under way.
    """
    bad, good = _scorer(error), _scorer(success)

    @F.pandas_udf("bad_word string, bad_score double, good_word string, good_score double, not_done boolean, under_way boolean")
    def near(told: pd.DataFrame) -> pd.DataFrame:
        nothing = (None, 0.0)
        text, settled = told["text"], told["not_done"].eq(True)
        asked = text.where(told["bad"].eq(True) & ~settled, None)
        wrong = bad(asked.dropna().unique())
        wrong_rows = [wrong.get(t, nothing) for t in asked]
        quiet = text.where(told["good"].eq(True) & ~settled & ~told["under_way"].eq(True), None)
        quiet = quiet.where([word is None for word, _ in wrong_rows], None)
        right = good(quiet.dropna().unique())
        rows = [(*w, *right.get(t, nothing)) for w, t in zip(wrong_rows, quiet)]
        out = pd.DataFrame(rows, columns=["bad_word", "bad_score", "good_word", "good_score"])
        out["not_done"], out["under_way"] = told["not_done"].to_numpy(), told["under_way"].to_numpy()
        return out

    def any_of(f: Column, keywords: Sequence[str]) -> Column:
        # a long text holds such pieces by chance, and seeking them takes longer than its score
        held = reduce(lambda a, b: a | b, [possible_keyword(f, k) for k in keywords if k], F.lit(False))
        return (F.length(f) > LONG_TEXT) | held

    # one level of `let`: Spark does not recognise a function of Python again whose argument nests them
    return near(let(folded, lambda f: F.struct(
        f.alias("text"), any_of(f, error).alias("bad"), any_of(f, success).alias("good"),
        f.rlike(K.NOT_DONE).alias("not_done"), f.rlike(K.UNDER_WAY).alias("under_way"),
    )))


def sync_text_status(
    text: Column,
    success: Sequence[str] = K.SUCCESS_KEYWORDS,
    error: Sequence[str] = K.ERROR_KEYWORDS,
    fuzzy: bool = True,
) -> Column:
    """struct(status, matched, confidence) of one text.

    A stated negation or an error word always wins over a success word, and an
    operation still under way is never a success. Long keywords also match near
    spellings: texts that hold enough pieces of one to reach its bar, which the
    JVM tells, are scored by an Arrow UDF. Without `fuzzy` only whole words do.
    """
    folded = fold_text(text, underscores=True)
    if fuzzy:
        found = _near_words(folded, error, success)
        bad, good = (F.struct(found[f"{n}_word"].alias("keyword"), found[f"{n}_score"].alias("score")) for n in ("bad", "good"))
        return _judge(text, found["not_done"], found["under_way"], bad, good)

    def exact(keyword: Column) -> Column:
        return F.struct(keyword.alias("keyword"), F.lit(100.0).alias("score"))

    return let(folded, lambda f: let(
        F.struct(exact_keyword(f, error).alias("bad"), exact_keyword(f, success).alias("good")),
        lambda w: _judge(text, f.rlike(K.NOT_DONE), f.rlike(K.UNDER_WAY), exact(w["bad"]), exact(w["good"])),
    ))


def _judge(text: Column, not_done: Column, under_way: Column, bad: Column, good: Column) -> Column:
    def outcome(status: str, matched: Column, confidence: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"), matched.cast("string").alias("matched"),
            confidence.cast("double").alias("confidence"),
        )

    nothing = outcome("UNCONFIRMED", F.lit(None), F.lit(0.0))
    return (
        F.when(~has_text(text), nothing)
        .when(not_done, outcome("FAILED", F.lit(K.TEXT_NOT_SYNCED), F.lit(1.0)))
        .when(bad["keyword"].isNotNull(), outcome("FAILED", bad["keyword"], bad["score"] / 100))
        .when(under_way, outcome("UNCONFIRMED", F.lit(K.TEXT_IN_PROGRESS), F.lit(0.0)))
        .when(good["keyword"].isNotNull(), outcome("SUCCESS", good["keyword"], good["score"] / 100))
        .otherwise(nothing)
    )
