"""Benchmark passages in documents, found by latent semantic retrieval and checked word by word.

Words are weighed by their inverse document frequency over the whole corpus,
counted in `BUCKETS` hashed buckets (a table of fixed size, whatever the
corpus). The benchmark's passages, in blocks of at most `BLOCK` items, form a
TF-IDF matrix of which a randomised SVD is taken in Spark: rows are multiplied
by a random matrix and by each other's factors in tasks, sums over terms are
made by grouping, and only matrices of a block's own size reach the driver. The
rank lies below the number of items, so words that occur in the same items
share directions, and an item stands for more than its own words.

Every document is cut into overlapping passages of a few lengths, those of the
items. A passage whose share of benchmark words cannot reach the cosine is left
out by the inequality of Cauchy and Schwarz, which holds for both cosines: the
others are compared with all items of the block as they are, and with the items
as the latent space holds them. The first finds every verbatim copy, however
little of an item lies in the space. A passage at `COSINE` or above by either
goes on to the exact checks: the longest common subsequence of words, and for
paraphrases the answer words, which are the rarest third of the item.

Words are lower-cased (A-Z) and parted by white space and ASCII punctuation. A
missing or empty text or item matches nothing. Repeated items and rows match
each for itself. An empty benchmark gives no links, an empty corpus none either.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import sent, slices, small_batches

BUCKETS = 1 << 20
_PARTS = 64
#: Items of a block, which are decomposed together and matched in one pass, and directions that are kept of them.
BLOCK = 2048
RANK = 128
#: Directions that are sought beside these, so that the last of them are right.
SPARE = 32
#: Items whose products with passages are summed at a time.
TILE = 256
COSINE = 0.5
#: Share of an item's words in common order that suffices alone, and with the answer words.
LCS_ALONE = 0.75
LCS_WITH_ANSWER = 0.5
ANSWER_SHARE = 0.6

#: Words of documents that are projected at a time.
STRETCH = 8192

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TABLE = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def buckets_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)).astype(np.int64) % BUCKETS


def _raw(column: pa.Array) -> list[bytes]:
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column]


def weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency of each bucket over all documents."""
    size = BUCKETS // _PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in slices(batches, "text"):
            found = [buckets_of(list(set(words_of(t)))) for t in _raw(batch.column(0))]
            documents += sum(1 for f in found if len(f))
            held += np.bincount(np.concatenate(found), minlength=BUCKETS)
        if documents:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(_PARTS)]), pa.array([np.int64(documents).tobytes(), *(held[i * size : (i + 1) * size].astype(np.int64).tobytes() for i in range(_PARTS))])],
                ["part", "counts"],
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, dtype=np.int64)
                held[part] = held[part] + own if part in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()])], ["part", "counts"])

    schema = "part long, counts binary"
    parts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(counted, schema).repartition(_PARTS, "part").mapInArrow(summed, schema)
    got = {r.part: np.frombuffer(r.counts, dtype=np.int64) for r in parts.collect()}
    if not got:
        return np.zeros(BUCKETS, dtype=np.float32)
    df = np.concatenate([got[i] for i in range(_PARTS)])
    return np.log((got[-1][0] + 1) / (df + 1)).clip(0.01).astype(np.float32)


def _random(terms: np.ndarray, rank: int) -> np.ndarray:
    """Rows of a fixed random normal matrix, one for each term."""
    with np.errstate(over="ignore"):
        x = terms.astype(np.uint64)[:, None] * np.uint64(2 * rank) + np.arange(2 * rank, dtype=np.uint64)
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    u = (x.astype(np.float64) + 1) / (2.0**64 + 1)
    return np.sqrt(-2 * np.log(u[:, :rank])) * np.cos(2 * np.pi * u[:, rank:])


def _row(words: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of an item, of length 1."""
    terms, counts = np.unique(buckets_of(words), return_counts=True)
    value = counts * idf[terms]
    return terms, value / max(float(np.linalg.norm(value)), 1e-12)


def randomised_svd(items: DataFrame, idf: np.ndarray, rank: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(terms, V): the first `rank` right singular vectors of the TF-IDF matrix of `items` (row, text), one row of V for each term in use.

    Each product with the matrix is a pass over the items; products with its transpose are summed over items by term.
    """
    first, rank = rank, rank + SPARE
    spark = items.sparkSession
    common = spark.sparkContext.broadcast(idf)

    def times(factor: dict[int, np.ndarray] | None) -> np.ndarray:
        other = spark.sparkContext.broadcast(factor)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text in _raw(batch.column(1)):
                    terms, value = _row(words_of(text), common.value)
                    rows = _random(terms, rank) if other.value is None else np.stack([other.value[t] for t in terms.tolist()] or [np.zeros(rank)] * 0).reshape(len(terms), rank)
                    out.append((value @ rows).tolist() if len(terms) else [0.0] * rank)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["row", "v"])

        got = items.mapInArrow(run, "row long, v array<double>").orderBy("row").toArrow()
        other.destroy()
        return got.column("v").combine_chunks().flatten().to_numpy().reshape(got.num_rows, rank)

    def transposed(factor: np.ndarray) -> dict[int, np.ndarray]:
        other = spark.sparkContext.broadcast(factor)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), strict=True):
                    terms, value = _row(words_of(text), common.value)
                    for term, x in zip(terms.tolist(), value.tolist(), strict=True):
                        held[term] = held.get(term, 0) + x * other.value[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["term", "v"]
            )

        parts = items.mapInArrow(run, "term long, v array<double>").select("term", F.posexplode("v").alias("j", "x"))
        sums = parts.groupBy("term", "j").agg(F.sum("x").alias("x")).groupBy("term")
        rows = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("v")).toArrow()
        other.destroy()
        return dict(zip(rows.column("term").to_pylist(), rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, rank), strict=True))

    basis, _ = np.linalg.qr(times(None))
    width = basis.shape[1]

    def padded(q: np.ndarray) -> np.ndarray:
        return np.pad(q, ((0, 0), (0, rank - q.shape[1])))

    for _ in range(rounds):
        basis, _ = np.linalg.qr(times(transposed(padded(basis))))
    found = transposed(padded(basis))
    terms = np.array(sorted(found), dtype=np.int64)
    small = np.stack([found[t] for t in terms.tolist()])[:, :width]
    values, vectors = np.linalg.eigh(small.T @ small)
    kept = [i for i in np.argsort(-values)[:first] if values[i] > values.max() * 1e-8]
    common.destroy()
    return terms, (small @ vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... rows; a passage is the difference of two."""
    out = np.zeros((len(rows) + 1, rows.shape[1]))
    np.cumsum(rows, axis=0, out=out[1:])
    return out


@dataclass
class Tile:
    """Items of a block that are nearest to one of its lengths: the row of each term of the block or -1, and one column for each item."""

    length: int
    items: np.ndarray
    place: np.ndarray
    matrix: np.ndarray


@dataclass
class Block:
    """What a worker needs of a block of items: weights, terms with latent vectors, and the items, in the latent space of length 1."""

    idf: np.ndarray
    terms: np.ndarray
    vectors: np.ndarray
    ids: list
    words: list[list[bytes]]
    latent: np.ndarray
    cosine: float

    def __post_init__(self):
        longest = max(map(len, self.words))
        self.lengths, size = [], max(4, min(map(len, self.words)))
        while True:
            self.lengths.append(size)
            if size >= longest:
                break
            size = int(size * 1.5) + 1
        # an item belongs to the nearest length, and is looked for among passages of that one
        nearest = np.array([int(np.argmin([abs(np.log(len(w) / s)) for s in self.lengths])) for w in self.words])
        self.tiles: list[Tile] = []
        for k in range(len(self.lengths)):
            every = np.flatnonzero(nearest == k)
            for items in (every[low : low + TILE] for low in range(0, len(every), TILE)):
                rows = [_row(self.words[i], self.idf) for i in items]
                terms = np.unique(np.concatenate([t for t, _ in rows]))
                matrix = np.zeros((len(terms), len(items)), dtype=np.float32)
                for column, (t, value) in enumerate(rows):
                    matrix[np.searchsorted(terms, t), column] = value
                place = np.full(len(self.terms), -1, dtype=np.int32)
                place[np.searchsorted(self.terms, terms)] = np.arange(len(terms))
                self.tiles.append(Tile(k, items, place, matrix))
        self.masks: list[dict[bytes, int]] = []
        self.answers: list[list[bytes]] = []
        for own in self.words:
            mask: dict[bytes, int] = {}
            for i, w in enumerate(own):
                mask[w] = mask.get(w, 0) | 1 << i
            self.masks.append(mask)
            kinds = sorted(mask, key=lambda w: (-float(self.idf[crc32(w) % BUCKETS]), w))
            self.answers.append(kinds[: max(1, len(kinds) // 3)])

    def common(self, item: int, words: list[bytes]) -> int:
        """Length of the longest common subsequence of an item and some words, by bit rows."""
        mask, full = self.masks[item], (1 << len(self.words[item])) - 1
        row = full
        for w in words:
            own = mask.get(w, 0)
            if own:
                met = row & own
                row = ((row + met) | (row - met)) & full
        return len(self.words[item]) - row.bit_count()

    def candidates(self, place: np.ndarray, weight: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, last word, cosine) of passages at the cosine or above; documents lie back to back.

        The cosine is that with the item's own words, or where that is too low, with the item in the latent space.
        """
        mass = np.r_[0, (weight.astype(np.float64) ** 2).cumsum()]
        inside = np.r_[0, (np.where(place >= 0, weight, 0).astype(np.float64) ** 2).cumsum()]
        begins = np.r_[0, ends[:-1]]
        last = np.repeat(ends, ends - begins)
        found = []
        for size in self.lengths:
            starts = np.union1d(np.arange(0, len(place), max(1, size // 4)), begins[begins < ends])
            stops = np.minimum(starts + size, last[starts])
            total = mass[stops] - mass[starts]
            able = (inside[stops] - inside[starts]) >= self.cosine**2 * total
            found.append((starts[able], stops[able], np.sqrt(np.maximum(total[able], 1e-12))))
        for low in range(0, len(place), STRETCH):
            own = [tuple(x[np.searchsorted(f[0], low) : np.searchsorted(f[0], low + STRETCH)] for x in f) for f in found]
            high = max((int(o[1].max()) for o in own if len(o[1])), default=low)
            if high == low:
                continue
            # words of the benchmark inside a passage that is left are projected once, and passages are differences of sums
            edge = np.zeros(high - low + 1, dtype=np.int64)
            for a, b, _ in own:
                np.add.at(edge, a - low, 1)
                np.add.at(edge, b - low, -1)
            used = (edge.cumsum()[:-1] > 0) & (place[low:high] >= 0)
            at = low + np.flatnonzero(used)
            sums = _sums(self.vectors[place[at]] * weight[at][:, None])
            count = np.r_[0, used.cumsum()]
            latent = [((sums[count[b - low]] - sums[count[a - low]]) / norm[:, None]).astype(np.float32) for a, b, norm in own]
            for tile in self.tiles:
                a, b, norm = own[tile.length]
                if not len(a):
                    continue
                rows = tile.place[place[at]]
                met = at[rows >= 0]
                sums = _sums(tile.matrix[rows[rows >= 0]] * weight[met][:, None])
                score = (sums[np.searchsorted(met, b)] - sums[np.searchsorted(met, a)]) / norm[:, None]
                score = np.where(score >= self.cosine, score, latent[tile.length] @ self.latent[tile.items].T)
                for p, i in zip(*np.nonzero(score >= self.cosine), strict=True):
                    yield int(tile.items[i]), int(a[p]), int(b[p]), float(score[p, i])

    def links(
        self, split: list[list[bytes]], every: list[bytes], ends: np.ndarray, buckets: np.ndarray
    ) -> list[tuple[int, int, float, int, float, int, int]]:
        """(document, item, cosine, common words, answer share, first word, last word): the best checked place of each pair."""
        best: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int, int]] = set()
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[self.terms] = np.arange(len(self.terms))
        for item, a, b, score in self.candidates(place[buckets], self.idf[buckets], ends):
            document = int(np.searchsorted(ends, a, side="right"))
            own = len(self.words[item])
            low = max(a - own // 2, int(ends[document] - len(split[document])))
            high = min(b + own // 2, int(ends[document]))
            if (item, low, high) in tried:
                continue
            tried.add((item, low, high))
            part = every[low:high]
            common, kinds = self.common(item, part), set(part)
            share = sum(w in kinds for w in self.answers[item]) / len(self.answers[item])
            if common >= LCS_ALONE * own or (common >= LCS_WITH_ANSWER * own and share >= ANSWER_SHARE):
                base = int(ends[document] - len(split[document]))
                found = (document, item, score, common, share, low - base, high - base)
                if (document, item) not in best or (common, score) > (best[document, item][3], best[document, item][2]):
                    best[document, item] = found
        return [best[k] for k in sorted(best)]


def links(group: list[Block], texts: list[bytes]) -> Iterator[tuple[Block, tuple[int, int, float, int, float, int, int]]]:
    """The links of each block of a group, with the block; texts are parted once."""
    split = [words_of(t) for t in texts]
    every = [w for s in split for w in s]
    if not every:
        return
    ends = np.cumsum([len(s) for s in split])
    buckets = buckets_of(every)
    for block in group:
        for found in block.links(split, every, ends, buckets):
            yield block, found


def blocks(docs: DataFrame, benchmark: DataFrame, idf: np.ndarray | None = None, cosine: float = COSINE, size: int = BLOCK) -> Iterator[Block]:
    """The blocks of a benchmark (item_id, text) against the weights of the documents; a block takes `BLOCK` items at most."""
    size = min(size, BLOCK)
    spark = docs.sparkSession
    idf = weights(docs) if idf is None else idf
    named = benchmark.select("item_id", F.col("text").alias("text")).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = iter(named.orderBy("item_id", "text").toLocalIterator())
    while True:
        block = [r for _, r in zip(range(size), rows, strict=False)]
        block = [(r.item_id, r.text) for r in block]
        if not block:
            return
        words = [words_of(t.encode()) for _, t in block]
        kept = [i for i, w in enumerate(words) if w]
        if not kept:
            continue
        own = [(n, block[i][1]) for n, i in enumerate(kept)]
        items = spark.createDataFrame(own, "row long, text string").repartition(max(1, len(own) // 256))
        # with as many directions as items the space would hold each item alone, and nothing would be latent
        terms, vectors = randomised_svd(items, idf, min(RANK, (len(own) + 1) // 2))
        place = {int(t): i for i, t in enumerate(terms)}
        latent = np.zeros((len(own), vectors.shape[1]), dtype=np.float32)
        for n, i in enumerate(kept):
            t, value = _row(words[i], idf)
            latent[n] = value.astype(np.float32) @ vectors[[place[int(x)] for x in t]]
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)
        yield Block(idf, terms, vectors, [block[i][0] for i in kept], [words[i] for i in kept], latent, cosine)


def groups(docs: DataFrame, benchmark: DataFrame, cosine: float, size: int) -> Iterator[list[Block]]:
    """The blocks that are matched in one pass: `BLOCK` items or a little less."""
    every = blocks(docs, benchmark, cosine=cosine, size=size)
    while group := [b for _, b in zip(range(max(1, BLOCK // min(size, BLOCK))), every, strict=False)]:
        yield group


def find(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, size: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, cosine, common_words, item_words, answer_share, first_word, last_word): every checked link."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, common_words long, item_words long, answer_share double, first_word long, last_word long"
    plain = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    out = None
    for group in groups(docs, benchmark, cosine, size):
        own, _ = sent(docs.sparkSession, group)

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                met = list(links(own(), _raw(batch.column(1))))
                found = [f for _, f in met]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], pa.int32())),
                        pa.array([b.ids[f[1]] for b, f in met], pa.from_numpy_dtype(np.int64) if item_kind == "bigint" else None),
                        pa.array([f[2] for f in found], pa.float64()),
                        pa.array([f[3] for f in found], pa.int64()),
                        pa.array([len(b.words[f[1]]) for b, f in met], pa.int64()),
                        pa.array([f[4] for f in found], pa.float64()),
                        pa.array([f[5] for f in found], pa.int64()),
                        pa.array([f[6] for f in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "cosine", "common_words", "item_words", "answer_share", "first_word", "last_word"],
                )

        part = plain.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, size: int = BLOCK) -> DataFrame:
    """The documents without a link to the benchmark, all columns as they were."""
    small_batches(docs.sparkSession)
    out = docs
    for group in groups(docs, benchmark, cosine, size):
        own, _ = sent(docs.sparkSession, group)

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                linked = {f[0] for _, f in links(own(), _raw(batch.column(batch.schema.get_field_index("text"))))}
                yield batch.filter(pa.array([i not in linked for i in range(batch.num_rows)]))

        out = out.mapInArrow(run, out.schema)
    return out
