"""Rules on the quality of a text: plain counts, and a band of perplexity for each language.

`rules` counts words, letters, symbols, repeated lines and repeated windows of
every whole text. `judge` adds the log perplexity under a letter n-gram model
and rejects documents outside their language's band: from the lower quartile
less `WIDTH` quartile distances to the upper one plus as much. A short text
says less about itself, so its band is wider, by the root of `SHORT` / letters.
The model is counted over all documents with enough words and no more than
`SYMBOL_SHARE` symbols for each word. The quartiles are those of their distinct
texts, so that copies of one text do not close the band, and the distance
counts as `LEAST_SPREAD` at least. Every document is scored and judged.

A missing or empty text has no words and fails the plain rules. A language that
is missing is one of its own. Repeated rows are judged alike. Where a
language has no band, the plain rules alone decide. Other columns
pass through; columns named like a count or a verdict are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm import ngram_lm
from proofline.llm.common import sent, slices, small_batches, stored, text_of

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
WIDTH = 3.0
SHORT = 1600
#: Quartile distance that a band has at least, and decimals of a log perplexity: copies may differ in their last bits.
LEAST_SPREAD = 0.03
DECIMALS = 9
SYMBOL_SHARE = 0.1
#: Rejected texts that are broadcast to take them out (about 40 bytes each).
REJECTED = 1_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    if len(words) <= window:
        return 0
    numbers = dict(zip(dict.fromkeys(words), range(len(words))))
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    base = len(numbers)
    if base == len(words):
        return 0
    starts = len(words) - window + 1
    code, held = ids[:starts], base
    for step in range(1, window):
        if held * base >= 1 << 62:  # renumber, so that numbers of windows stay exact
            kinds, code = np.unique(code, return_inverse=True)
            held = len(kinds)
        code = code * base + ids[step : step + starts]
        held *= base
    order = np.sort(code)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    where = np.flatnonzero(twice)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + window, -1)
    return int((edge.cumsum() > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = text.split()
    letters = text.translate(None, SPACES)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(letters.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def reads_as_prose(text: bytes) -> bool:
    """Whether a text may teach the model what ordinary writing looks like."""
    words = len(text.split())
    return words >= LEAST_WORDS and len(text) - len(text.translate(None, SYMBOLS)) <= SYMBOL_SHARE * words


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules(df: DataFrame, model: Callable[[], ngram_lm.Arrays] | None = None) -> DataFrame:
    """Every row without its text, with `key` (hash of the text), the counts, `base_failed`, and `log_perplexity`: null unless a
    function is given that reads a model's arrays in a task."""
    made = ["key", *_COUNTS, "log_perplexity"]
    plain = df.select("text", *[F.col(f"`{c}`") for c in df.columns if c not in (*made, "base_failed", "text")])
    names = plain.columns[1:]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column("text")]
            found = np.array([counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            langs = batch.column("__lang").to_pylist()
            logs = ngram_lm.mean_log(model(), texts, langs) if model else [None] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), batch.column("__key"), *(pa.array(c) for c in found.T), pa.array(logs, pa.float64())],
                [*names, *made],
            )

    fields = [T.StructField("key", T.LongType()), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("log_perplexity", T.DoubleType())]
    read = plain.select("*", F.xxhash64(text_of()).alias("__key"), F.col("lang").cast("string").alias("__lang"))
    out = read.mapInArrow(run, T.StructType([*plain.schema.fields[1:], *fields]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def judge(df: DataFrame, width: float = WIDTH) -> DataFrame:
    """Every row without its text, with `key`, counts, `base_failed`, `log_perplexity` and the verdict `kept`; stored once."""
    small_batches(df.sparkSession)
    plain = df.select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    model = ngram_lm.trained(plain, accept=reads_as_prose)
    found = ngram_lm.gathered(model)
    if found is not None:
        arrays, held = sent(df.sparkSession, found)
        found = None
        rows = stored(rules(df, arrays), "quality")
        held.destroy()
    else:
        scores = ngram_lm.joined_scores(plain, ngram_lm.by_order(model)).withColumnsRenamed({"key": "__k", "lang": "__l", "log_perplexity": "__p"})
        same = (F.col("key") == F.col("__k")) & F.col("lang").cast("string").eqNullSafe(F.col("__l"))
        met = rules(df).join(scores, same, "left").withColumn("log_perplexity", F.col("__p"))
        rows = stored(met.drop("__k", "__l", "__p"), "quality")
    rows = rows.withColumn("log_perplexity", F.round("log_perplexity", DECIMALS))
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    prose = ~F.col("base_failed") & (F.col("n_symbols") <= SYMBOL_SHARE * F.col("n_words"))
    texts = rows.filter(prose).groupBy("key", F.col("lang").cast("string").alias("__lang")).agg(F.min("log_perplexity").alias("log_perplexity"))
    bands = texts.groupBy("__lang").agg(quartiles.alias("__q"))
    # one row per language: small, and left to Spark to send or to shuffle
    met = rows.join(bands, F.col("lang").cast("string").eqNullSafe(F.col("__lang")), "left")
    low, high = F.col("__q")[0], F.col("__q")[1]
    room = width * F.greatest(high - low, F.lit(LEAST_SPREAD)) * (1 + F.sqrt(F.lit(float(SHORT)) / F.greatest("word_chars", F.lit(1))))
    inside = F.col("log_perplexity").between(low - room, high + room)
    return met.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("__lang", "__q")


def keep(df: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns, whatever they are called.

    A verdict depends on text and language alone, so the rejected (hash, language) pairs are taken out by an anti join.
    Up to `REJECTED` of them are broadcast, which leaves the texts where they are; beyond that Spark shuffles.
    """
    verdict = judge(df.select("text", "lang")).filter("NOT kept").select(
        F.col("key").alias("__key"), F.col("lang").cast("string").alias("__lang")
    ).distinct()
    rejected = stored(verdict, "rejected")
    if rejected.count() <= REJECTED:
        rejected = F.broadcast(rejected)
    same = (F.xxhash64(text_of()) == F.col("__key")) & F.col("lang").cast("string").eqNullSafe(F.col("__lang"))
    return df.join(rejected, same, "left_anti")


def report(df: DataFrame) -> DataFrame:
    """Per document its counts, whether the plain rules fail, and the verdict."""
    return judge(df.select("doc_id", "text", "lang")).select(
        "doc_id", *_COUNTS, "base_failed", "kept", "log_perplexity"
    )
