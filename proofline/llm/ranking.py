"""Ranked lexical search by dense blocked products of item weights and document impacts.

Items are dealt to tiles of bounded size; a tile's terms are numbered, and only
they are looked for in the documents. Documents are counted once and stored as
(number of terms, term numbers, occurrences). Then blocks of documents meet the
tile: terms that the block does not hold are left out, impacts fill a dense
float64 matrix, and BLAS multiplies it with the items' weights, a stretch of terms
at a time. A stretch is short enough that its sums stay below 2^53, so they are
exact; stretches are added as 64-bit integers. Each task keeps the best documents
of each item by score and id, all those level with the last one included until
the ids have decided.

Null texts have no terms. Documents and items without terms are in no result. Every
row of a table counts on its own, repeated ones too; equal scores go by ascending
doc_id, missing ids last. Items of the same id are ranked each on its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.common import sent, slices, small_batches, stored

#: Pairs of item and term in a tile, about; what is sent to the workers is bounded by it.
PAIRS = 200_000
#: Items in a tile: a row of scores for each of them and each document of a block.
ITEMS = 512
#: Documents in a block, and terms in a stretch.
BLOCK = 512
STRETCH = 2048
#: Sums of float64 products below this are exact.
EXACT = 1 << 53
#: No impact is larger.
IMPACT = 1_000_000
#: Into how many parts the candidates of an item are dealt for the first of two rounds of ranking.
PARTS = 32

#: All bytes but ASCII letters, digits and those of letters beyond ASCII become a space; A to Z become small.
LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order, in UTF-8."""
    return text.encode().translate(LOWER).split()


@dataclass
class Tile:
    """Some items and their terms. Pairs are sorted by term: those of term t are from starts[t] to starts[t + 1]."""

    numbers: dict[bytes, int]
    keys: list[int]
    items: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Tile:
        keys, pairs, numbers = [], [], {}
        for key, text in rows:
            pairs.extend((numbers.setdefault(t, len(numbers)), len(keys)) for t in dict.fromkeys(terms(text)))
            keys.append(key)
        pairs.sort()
        table = np.array(pairs, np.int64).reshape(-1, 2)
        return cls(numbers, keys, table[:, 1], np.searchsorted(table[:, 0], np.arange(len(numbers) + 1)))

    def weights(self, used: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Items by terms: the weight of a term where the item holds it."""
        out = np.zeros((len(self.keys), used.size))
        for column, term in enumerate(used.tolist()):
            out[self.items[self.starts[term] : self.starts[term + 1]], column] = weight[term]
        return out


def counted(docs: DataFrame, tile, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with at least one term: id, number of terms, and the tile's terms among them with their occurrences."""
    schema = "doc_id long, n long, terms binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = tile().numbers
        get = numbers.get
        for batch in slices(batches, "text"):
            ids, ns, found, times = [], [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = terms(value) if value else []
                if own:
                    known = np.array([i for i in map(get, own) if i is not None], np.int32)
                    term, count = np.unique(known, return_counts=True)
                    ids.append(key)
                    ns.append(len(own))
                    found.append(term.astype("<i4").tobytes())
                    times.append(count.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary())],
                ["doc_id", "n", "terms", "counts"],
            )

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the tile's terms occurs: summed in each task, then over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)
        self.kept: list[list[np.ndarray]] = []
        self.size, self.most = 0, 4 * items * k

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Scores of a block, items by documents. Whatever is level with an item's last place stays."""
        if scores.shape[1] > self.k:
            last = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            np.maximum(self.floor, last, out=self.floor)
        item, doc = np.nonzero(scores >= self.floor[:, None])
        self.kept.append([item, scores[item, doc], missing[doc], ids[doc]])
        self.size += item.size
        if self.size > self.most:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """Cuts each item at k by score and id: item, score, whether the id is missing, id."""
        columns = [np.concatenate(c) for c in zip(*self.kept, strict=True)] if self.kept else [np.empty(0, np.int64)] * 4
        item, score, missing, ids = columns
        order = np.lexsort((ids, missing, -score, item))
        ranked = item[order]
        order = order[np.arange(ranked.size) - np.searchsorted(ranked, ranked) < self.k]
        columns = [c[order] for c in columns]
        self.kept, self.size = [columns], order.size
        # a full item takes nothing below its last score any more
        full = np.bincount(columns[0], minlength=self.floor.size) >= self.k
        ends = np.searchsorted(columns[0], np.arange(self.floor.size), side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], columns[1][ends[full]])
        return columns


def scored(rows: DataFrame, tile, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """The k best documents of each item and task, by blocked products."""
    schema = "item long, doc_id long, score long"
    stretch = max(1, min(STRETCH, EXACT // (IMPACT * max(1, int(weight.max(initial=1))))))

    def block(own: Tile, best: Best, batch: pa.RecordBatch) -> None:
        sizes = np.array([len(t) // 4 for t in batch.column(2).to_pylist()], np.int64)
        term = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4")
        tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        n = batch.column(1).to_numpy()
        m = 100 - 50 + (50 * n * documents) // length
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        used, place = np.unique(term, return_inverse=True)
        scores = np.zeros((len(own.keys), batch.num_rows), np.int64)
        for begin in range(0, used.size, stretch):
            inside = (place >= begin) & (place < begin + stretch)
            part = used[begin : begin + stretch]
            dense = np.zeros((part.size, batch.num_rows))
            dense[place[inside] - begin, doc[inside]] = impact[inside]
            scores += (own.weights(part, weight) @ dense).astype(np.int64)
        ids = batch.column(0)
        missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        best.add(scores, ids.fill_null(0).to_numpy(), missing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tile()
        best = Best(len(own.keys), k)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                block(own, best, batch.slice(begin, BLOCK))
        item, score, missing, ids = best.settle()
        keys = np.array(own.keys, np.int64)[item]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64(), mask=missing > 0), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(run, schema)


def _tiles(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with a key for each row and the number of the tile they are in, stored; and how many tiles there are."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    n, pairs = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(words), F.lit(0))).first()
    tiles = max(1, -(-n // ITEMS), -(-pairs // PAIRS))
    keyed = items.withColumn("key", F.monotonically_increasing_id())
    return stored(keyed.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")), "items"), tiles


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text") -> DataFrame:
    """For each item its k highest documents: `item_id`, `rank` from 1, `doc_id`, `score`. Scores of zero are left out.

    Runs jobs while it is built: it counts the documents' terms for each tile of items (one up to about `ITEMS`
    items) and stores the candidates.
    """
    spark = docs.sparkSession
    picked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{query}`").cast("string").alias("text"))
    keyed, tiles = _tiles(picked)
    found = None
    for number in range(tiles):
        rows = keyed.filter((F.col("tile") == number) & F.col("text").isNotNull()).select("key", "text").collect()
        own = Tile.of(sorted((r.key, r.text) for r in rows))
        get, sent_tile = sent(spark, own)
        held = stored(counted(docs, get, doc_id, text), "counted")
        documents, length = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if documents and own.numbers:
            df = frequencies(held, len(own.numbers))
            weight = np.floor(1000 * np.log((2.0 * documents + 2.0) / (2.0 * df + 1.0))).astype(np.int64)
            part = stored(scored(held, get, weight, documents, length, k), "candidates")
            found = part if found is None else found.unionByName(part)
        sent_tile.destroy()
    if found is None:
        return keyed.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # two rounds, so that no task ranks what all tasks have found for an item
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    for keys in (["item", "part"], ["item"]):
        dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    names = keyed.select(F.col("key").alias("item"), "item_id")
    return dealt.join(names, "item").select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 50 best documents of each item of the benchmark."""
    return search(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


#: Terms that a benchmark item holds are all that needs counting; the rest only adds to a document's length.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
q AS MATERIALIZED (SELECT DISTINCT q, item_id, unnest(t) AS term FROM i),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
f AS MATERIALIZED (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
o AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM f
    WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * s.n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
    FROM o, s GROUP BY term, s.n),
c AS (SELECT q.q, q.item_id, o.r, o.doc_id, CAST(sum(w.w * ((1000000000 * o.tf) // (1000 * o.tf + 20 * (50 + (50 * o.n * s.n) // s.l)))) AS BIGINT) AS score
    FROM o JOIN q USING (term) JOIN w USING (term), s GROUP BY q.q, q.item_id, o.r, o.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
