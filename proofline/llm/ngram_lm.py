"""Letter n-gram model with modified Kneser-Ney smoothing: counted in Spark, kept in sorted hash arrays.

Words are lower-cased and joined by one space; each letter is predicted from
the `order - 1` letters before it, beginnings being marked. Each language has
its own counts. The highest order counts occurrences, the lower ones count
distinct letters to the left; discounts come from the counts of counts of each
language and order. All tables are made by grouping and joining, for all
orders at once where one does not need another.

For scoring the model is a set of arrays sorted by hash. They go to the workers
if they have at most `BROADCAST_ROWS` entries; a larger model stays a table,
and the n-grams counted per text are joined with it. Both ways give the same
figures.

Texts without a word have no score (null). A missing language is a language.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import slices, stored

ORDER = 5
MARK = 2
#: Entries of a model that is sent to the workers: 17 bytes each on the driver, 16 in a worker.
BROADCAST_ROWS = 6_000_000
#: Distinct n-grams that a counting task holds before it hands them on.
HELD = 1_500_000
#: Log probability of a letter never met in a language.
UNKNOWN = math.log(1e-6)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def letters(text: bytes) -> np.ndarray:
    """Code points of the normalised text."""
    joined = " ".join(text.decode("utf-8", "replace").lower().split())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def seed(lang: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"\0" if lang is None else lang.encode())


def rolled(codes: np.ndarray, seeds: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` letters that start at each place; seeds tell languages apart."""
    out = seeds.copy()
    with np.errstate(over="ignore"):
        for step in range(length):
            out *= _FACTOR
            out += codes[places + step]
        out ^= out >> np.uint64(29)
    return out


def rolled_all(codes: np.ndarray, seeds: np.ndarray, length: int) -> np.ndarray:
    """The same hashes at every place, in one sweep."""
    size = max(0, len(codes) - length + 1)
    out = seeds[:size].copy()
    with np.errstate(over="ignore"):
        for step in range(length):
            out *= _FACTOR
            out += codes[step : step + size]
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Windows:
    """The n-grams of some texts, back to back; `sizes` counts those of each text, `all_seeds` goes with `codes`."""

    codes: np.ndarray
    places: np.ndarray
    seeds: np.ndarray
    sizes: np.ndarray
    all_seeds: np.ndarray


def windows(texts: list[bytes], langs: list[str | None], order: int) -> Windows:
    mark = np.full(order - 1, MARK, dtype=np.uint32)
    bodies = [letters(t) for t in texts]
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    codes = np.concatenate([x for b in bodies for x in (mark, b)] or [mark]).astype(np.uint64)
    begins = np.r_[0, (sizes + order - 1).cumsum()[:-1]] if len(sizes) else sizes
    places = np.repeat(begins - np.r_[0, sizes.cumsum()[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else sizes
    own = np.array([seed(x) for x in langs], dtype=np.uint64)
    return Windows(codes, places, np.repeat(own, sizes), sizes, np.repeat(own, sizes + order - 1))


def counted(seen: Windows, order: int) -> tuple[list[str], list[int]]:
    """The distinct n-grams of some texts of one language, and how often each occurs."""
    if not len(seen.places):
        return [], []
    alphabet = np.unique(seen.codes)
    if len(alphabet) > 4096 or order > 5:
        hashes = rolled(seen.codes, seen.seeds, seen.places, order)
        _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        return spelled(seen.codes, seen.places[first], order), counts.tolist()
    # up to 4096 kinds of letters: an n-gram fits 60 bits and can be read back after sorting
    number = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
    number[alphabet] = np.arange(len(alphabet))
    short = number[seen.codes]
    packed = np.zeros(len(short) - order + 1, dtype=np.int64)
    for step in range(order):
        packed = (packed << 12) | short[step : step + len(packed)]
    packed = np.sort(packed[seen.places])
    cut = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    kinds, counts = packed[cut], np.diff(np.r_[cut, len(packed)])
    rows = alphabet[np.stack([kinds >> (12 * (order - 1 - step)) & 4095 for step in range(order)], axis=1)].astype("<u4")
    text = rows.tobytes().decode("utf-32-le", "replace")
    return [text[i : i + order] for i in range(0, len(text), order)], counts.tolist()


def spelled(codes: np.ndarray, places: np.ndarray, order: int) -> list[str]:
    """The n-grams at the places, as strings."""
    rows = codes[places[:, None] + np.arange(order)].astype("<u4")
    text = rows.tobytes().decode("utf-32-le", "replace")
    return [text[i : i + order] for i in range(0, len(text), order)]


def _raw(column: pa.Array) -> list[bytes]:
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column]


def count_ngrams(df: DataFrame, order: int = ORDER, accept: Callable[[bytes], bool] | None = None) -> DataFrame:
    """(lang, gram, n): occurrences over whole texts; `df` has text and lang. Texts that `accept` refuses are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, dict[str, int]] = {}

        def out() -> pa.RecordBatch:
            langs = [x for x, found in held.items() for _ in found]
            grams = [g for found in held.values() for g in found]
            counts = [n for found in held.values() for n in found.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["lang", "gram", "n"]
            )

        for batch in slices(batches, "text"):
            by_lang: dict[str | None, list[bytes]] = {}
            for text, lang in zip(_raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if accept is None or accept(text):
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                seen = windows(texts, [lang] * len(texts), order)
                found = held.setdefault(lang, {})
                for gram, n in zip(*counted(seen, order), strict=True):
                    found[gram] = found.get(gram, 0) + n
            if sum(map(len, held.values())) > HELD:
                yield out()
                held.clear()
        yield out()

    parts = df.select("text", "lang").mapInArrow(run, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, order, d1, d2, d3, letters) of each order, from its counts of counts."""
    n = {k: F.sum((F.col("n") == k).cast("double")) for k in (1, 2, 3, 4)}
    found = grams.groupBy("lang", "k").agg(*[v.alias(f"n{k}") for k, v in n.items()], F.count(F.lit(1)).alias("size"))
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def discount(k: int):
        raw = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        # a table too small for the estimate takes the plain half
        return F.when((raw > 0) & (raw < k), raw).otherwise(0.5).alias(f"d{k}")

    return found.select(F.col("lang").alias("dl"), F.col("k").alias("dk"), discount(1), discount(2), discount(3), "size")


def _lower_counts(grams: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of all orders below: of each n-gram the distinct letters met to its left."""
    longer = F.array(*[F.expr(f"substring(gram, {order - k})") for k in range(1, order)])
    kinds = grams.select("lang", F.explode(longer).alias("longer")).distinct()
    return kinds.groupBy("lang", F.expr("substring(longer, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def trained(df: DataFrame, order: int = ORDER, accept: Callable[[bytes], bool] | None = None) -> DataFrame:
    """Stored table (k, lang, gram, p, backoff) of all orders k: p of the last letter after the others.

    `backoff` is what the letters of `gram` as a context leave to the order below, null where `gram` never is a context.
    All orders share each step but the interpolation, which goes up by one order a step: every stage and scan costs the
    driver memory, however few rows it has.
    """
    counts = stored(count_ngrams(df, order, accept), "ngrams")
    if order > 1:
        counts = counts.unionByName(stored(_lower_counts(counts, order), "ngrams"))
    counts = counts.withColumn("k", F.length("gram"))
    # one row per language and order
    discounts = stored(_discounts(counts), "ngram-discounts")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.join(F.broadcast(discounts), F.col("lang").eqNullSafe(F.col("dl")) & (F.col("k") == F.col("dk"))).withColumn("d", d)
    rows = rows.withColumn("context", F.expr("substring(gram, 1, k - 1)")).drop("dl", "dk")
    sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("lost"))
    gamma = (F.col("lost") / F.col("total")).alias("gamma")
    left = stored(sums.select(F.col("lang").alias("cl"), F.col("context").alias("c"), "total", gamma), "ngram-contexts")
    met = rows.join(left, F.col("lang").eqNullSafe(F.col("cl")) & (F.col("context") == F.col("c")))
    shares = stored(met.select("k", "lang", "gram", "size", "gamma", ((F.col("n") - F.col("d")) / F.col("total")).alias("own")), "ngram-shares")
    out = [shares.filter("k = 1").select("k", "lang", "gram", (F.col("own") + F.col("gamma") / (F.col("size") + 1)).alias("p"))]
    for k in range(2, order + 1):
        below = out[-1].select(F.col("lang").alias("bl"), F.col("gram").alias("b"), F.col("p").alias("q"))
        same = F.col("lang").eqNullSafe(F.col("bl")) & (F.expr("substring(gram, 2)") == F.col("b"))
        p = (F.col("own") + F.col("gamma") * F.col("q")).alias("p")
        out.append(stored(shares.filter(F.col("k") == k).join(below, same).select("k", "lang", "gram", p), "ngram-model"))
    # a context has the length of the order below, and the highest order is none
    contexts = left.filter("c != ''").select("cl", "c", F.col("gamma").alias("backoff"))
    whole = out[-1].withColumn("backoff", F.lit(None).cast("double"))
    if order > 1:
        met = reduce(DataFrame.unionByName, out[:-1]).join(contexts, F.col("lang").eqNullSafe(F.col("cl")) & (F.col("gram") == F.col("c")), "full")
        gram = F.coalesce("gram", "c")
        whole = whole.unionByName(met.select(F.length(gram).alias("k"), F.coalesce("lang", "cl").alias("lang"), gram.alias("gram"), "p", "backoff"))
    return stored(whole, "ngram-model")


def by_order(model: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """Per order its table (lang, gram, p, backoff)."""
    return {k: model.filter(F.col("k") == k).drop("k") for k in range(1, order + 1)}


def train(df: DataFrame, order: int = ORDER, accept: Callable[[bytes], bool] | None = None) -> dict[int, DataFrame]:
    """The model of `trained`, per order."""
    return by_order(trained(df, order, accept), order)


@dataclass
class Arrays:
    """A model as arrays sorted by hash: of each order its hashes, log probabilities and log back-off weights."""

    order: int
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    p: dict[int, np.ndarray] = field(default_factory=dict)
    backoff: dict[int, np.ndarray] = field(default_factory=dict)
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = field(default_factory=dict)

    def open(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """An order's entries in slots with free ones between, in order of their mixed hash: each in the slot that its first
        bits name, or as soon after as may be. Made where it is used, once for a worker."""
        if k not in self.slots:
            own = self.hashes[k] * _FACTOR
            by = np.argsort(own)
            own = own[by]
            size = np.uint64(max(1, len(own) + len(own) // 2))
            home = ((own >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64)
            number = np.arange(len(own))
            place = np.maximum.accumulate(home - number) + number
            width = max(int(size), int(place.max(initial=-1)) + 1) + 1
            found = np.full(width, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            found[place] = own
            logs = [np.full(width, np.nan, dtype=np.float32) for _ in range(2)]
            for held, values in zip(logs, (self.p[k], self.backoff[k]), strict=True):
                held[place] = values[by]
            self.slots[k] = found, *logs, size
        return self.slots[k]

    def find(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of hashes among those of an order, and which are there.

        N-grams that differ in their last letter have hashes that differ in their last bits, so hashes are mixed first.
        """
        own, _, _, size = self.open(k)
        mixed = hashes * _FACTOR
        at = ((mixed >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64)
        met = own[at]
        short = np.flatnonzero(met < mixed)
        while len(short):
            at[short] += 1
            again = own[at[short]]
            met[short] = again
            short = short[again < mixed[short]]
        return at, met == mixed

    def score(self, seen: Windows) -> np.ndarray:
        """Log probability of the last letter of each n-gram."""
        out = np.zeros(len(seen.places))
        todo = np.arange(len(seen.places))
        for k in range(self.order, 0, -1):
            start = seen.places[todo] + (self.order - k)
            if k == self.order:
                hashes = rolled_all(seen.codes, seen.all_seeds, k)[seen.places]
            else:
                hashes = rolled(seen.codes, seen.seeds[todo], start, k)
            at, found = self.find(k, hashes)
            p = self.open(k)[1][at]
            known = found & ~np.isnan(p)
            out[todo[known]] += p[known]
            todo, start = todo[~known], start[~known]
            if not len(todo):
                return out
            if k > 1:
                at, found = self.find(k - 1, rolled(seen.codes, seen.seeds[todo], start, k - 1))
                weight = self.open(k - 1)[2][at]
                out[todo] += np.where(found & ~np.isnan(weight), weight, 0)
        out[todo] += UNKNOWN
        return out


def arrays(model: dict[int, DataFrame]) -> Arrays | None:
    """The model as sorted arrays, or None if it has more than `BROADCAST_ROWS` entries."""
    rows = reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("k"), "lang", "gram", "p", "backoff") for k, t in model.items()])
    return gathered(rows, max(model))


def gathered(rows: DataFrame, order: int = ORDER) -> Arrays | None:
    """The same of a table of all orders."""
    if rows.count() > BROADCAST_ROWS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = batch.column(0).to_numpy()
            for k in np.unique(orders).tolist():
                part = batch.filter(pa.array(orders == k))
                langs, grams = part.column(1).to_pylist(), part.column(2).to_pylist()
                found = {x: seed(x) for x in set(langs)}
                codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
                seeds = np.array([found[x] for x in langs], dtype=np.uint64)
                hashes = rolled(codes, seeds, np.arange(len(grams)) * k, k).view(np.int64)
                logs = [pa.array(np.log(c.to_numpy(zero_copy_only=False).astype(float)).astype(np.float32)) for c in part.columns[3:5]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes), *logs], ["k", "hash", "p", "backoff"])

    got = rows.select("k", "lang", "gram", "p", "backoff").mapInArrow(run, "k int, hash long, p float, backoff float").toArrow()
    orders, hashes = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64)
    p, backoff = got.column(2).to_numpy(), got.column(3).to_numpy()
    got = None
    out = Arrays(order)
    for k in range(1, order + 1):
        own = np.flatnonzero(orders == k)
        own = own[np.argsort(hashes[own])]
        out.hashes[k], out.p[k], out.backoff[k] = hashes[own], p[own], backoff[own]
    orders = hashes = p = backoff = None
    pa.default_memory_pool().release_unused()
    return out


def mean_log(model: Arrays, texts: list[bytes], langs: list[str | None]) -> list[float | None]:
    """Minus the mean log probability of a letter of each text: the log of its perplexity."""
    out: list[float | None] = []
    seen = windows(texts, langs, model.order)
    total = np.r_[0.0, model.score(seen)]
    total = total.cumsum()
    ends = seen.sizes.cumsum()
    for size, end in zip(seen.sizes.tolist(), ends.tolist(), strict=True):
        out.append(float(total[end - size] - total[end]) / size if size else None)
    return out


def spelled_out(kinds: DataFrame, model: dict[int, DataFrame]) -> DataFrame:
    """(lang, gram, log_p) of distinct n-grams of the highest order, by a join with the tables of each order."""
    order = max(model)
    rows = kinds.select("lang", "gram", F.lit(None).cast("double").alias("log_p"), F.lit(0.0).alias("weight"))
    for k in range(order, 0, -1):
        own = model[k].filter("p is not null").select(F.col("lang").alias("ml"), F.col("gram").alias("mg"), F.log("p").alias("mp"))
        same = F.col("lang").eqNullSafe(F.col("ml")) & (F.expr(f"substring(gram, {order - k + 1})") == F.col("mg"))
        rows = rows.join(own, same, "left").withColumn("log_p", F.coalesce("log_p", F.col("weight") + F.col("mp"))).drop("ml", "mg", "mp")
        if k > 1:
            less = model[k - 1].filter("backoff is not null").select(
                F.col("lang").alias("ml"), F.col("gram").alias("mg"), F.log("backoff").alias("mp")
            )
            same = F.col("lang").eqNullSafe(F.col("ml")) & (F.expr(f"substring(gram, {order - k + 1}, {k - 1})") == F.col("mg"))
            rows = rows.join(less, same, "left").withColumn("weight", F.col("weight") + F.coalesce("mp", F.lit(0.0))).drop("ml", "mg", "mp")
    return rows.select("lang", "gram", F.coalesce("log_p", F.col("weight") + F.lit(UNKNOWN)).alias("log_p"))


def joined_scores(df: DataFrame, model: dict[int, DataFrame]) -> DataFrame:
    """(key, lang, log_perplexity) per distinct text and language by joins with the tables of the model."""
    order = max(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for key, text, lang in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                seen = windows([text], [lang], order)
                grams, counts = counted(seen, order)
                size = len(grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * size, pa.int64()), pa.array([lang] * size, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())],
                    ["key", "lang", "gram", "n"],
                )

    texts = df.select(F.xxhash64("text").alias("key"), "text", "lang").dropDuplicates(["key", "lang"])
    grams = stored(texts.mapInArrow(run, "key long, lang string, gram string, n long"), "text-ngrams")
    kinds = spelled_out(grams.select("lang", "gram").distinct(), model).withColumnsRenamed({"lang": "ml", "gram": "mg"})
    met = grams.join(kinds, F.col("lang").eqNullSafe(F.col("ml")) & (F.col("gram") == F.col("mg")))
    return met.groupBy("key", "lang").agg((-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("log_perplexity"))
