"""Near-duplicate documents by SimHash, found through an inverted index of fingerprint bytes.

Fingerprints that differ in at most `RADIUS` = 3 of 64 bits share at least 5 of
their 8 positional bytes. The index lists each fingerprint under positional
bytes in sets: any 3 of positions 0 to 5, since of 5 shared bytes at most 2 lie
elsewhere. Fingerprints that meet under a set have their shared positional
bytes tallied; pairs with 5 or more are verified by counting differing bits.

Only links that join parts go out of a task, never all pairs of a list. Lists
longer than `LIST_LIMIT` are indexed again within: first by 2 of the 5 bytes
left (2 more of them must be shared), then by 3 of the 6 half bytes of what is
left, where at most 4096 fingerprints can meet. So no list is ever cut.

Texts are whole. Nulls and empty texts have fingerprint zero and are linked
like any other. Equal fingerprints meet before the index, so copies cost one
entry. Rows with the same id are rows of their own; a null id belongs to the
group of its fingerprint but names it (by null) only where no other id does.
Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import small_batches, stored, text_of
from proofline.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
LIST_LIMIT = 4096
#: Links held in a task before they are thinned to those that join parts.
EDGE_LIMIT = 1_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BIT_OF_BYTE = np.array([[value >> (7 - bit) & 1 for bit in range(8)] for value in range(256)], dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if more than half of its shingles' hashes have it."""
    import xxhash

    words = text.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), dtype=np.int64, count=len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[len(words) - n :] if len(words) >= shingle else ends[-1:]
    parts = map(joined.__getitem__, map(slice, starts[:n].tolist(), last.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=n)
    octets = hashes.astype(">u8").view(np.uint8).reshape(n, 8).astype(np.int64)
    tally = np.bincount((octets + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
    bits = (tally @ _BIT_OF_BYTE).ravel() * 2 > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(v.as_buffer().to_pybytes() if v.is_valid else b"", shingle) for v in batch.column(1)),
                dtype=np.uint64, count=batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    small_batches(df.sparkSession)
    narrow = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, fp long")


def _masks(unit: int, places: list[int], taken: int) -> list[int]:
    """Bit masks of every set of `taken` places; a place is `unit` bits wide, 0 the highest."""
    ones = (1 << unit) - 1
    return [sum(ones << (64 - unit * (p + 1)) for p in chosen) for chosen in combinations(places, taken)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _first_masks() -> list[int]:
    return _masks(8, list(range(6)), 3)


def _next_masks(mask: int) -> list[int]:
    """Masks within a list of this mask: 3 bytes become 5, 5 bytes become 52 bits."""
    free = [p for p in range(8) if not mask >> (64 - 8 * (p + 1)) & 255]
    if len(free) == 5:
        return [mask | m for m in _masks(8, free, 2)]
    nibbles = [n for p in free for n in (2 * p, 2 * p + 1)]
    return [mask | m for m in _masks(4, nibbles, 3)]


def _index(nodes: DataFrame, masks: Column) -> DataFrame:
    """One row per fingerprint and mask: (mask, part, fp), part being the positional bytes under the mask."""
    return nodes.select("fp", F.explode(masks).alias("mask")).select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp"
    )


def _thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same parts as the given ones, at most one per fingerprint."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes two arrays of fingerprints share, pair by pair."""
    return (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(axis=1)


def _pairs(mask: np.ndarray, part: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the lists of a sorted run of index rows, thinned as they come."""
    least = 8 - radius
    found_a, found_b, held = [], [], 0
    rows, step = np.arange(len(fp)), 1
    while len(rows):
        rows = rows[rows + step < len(fp)]
        rows = rows[(mask[rows] == mask[rows + step]) & (part[rows] == part[rows + step])]
        a, b = fp[rows], fp[rows + step]
        near = _shared(a, b) >= least
        a, b = a[near], b[near]
        close = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        found_a.append(a[close])
        found_b.append(b[close])
        held += int(close.sum())
        if held > EDGE_LIMIT:
            a, b = _thin(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
        step += 1
    if not held:
        return fp[:0], fp[:0]
    return _thin(np.concatenate(found_a), np.concatenate(found_b))


def _linked(index: DataFrame, radius: int, limit: int) -> DataFrame:
    """Links within lists of up to `limit` rows as (a, b, null); members of longer lists as (fp, null, mask).

    Rows come sorted by list. A task holds the rows of whole short lists, or the beginning of one long one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _pairs(rows[0], rows[1], rows[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "mask"])

        def members(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[2]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0])], ["a", "b", "mask"]
            )

        held = np.empty((3, 0), dtype=np.int64)
        long_list: tuple[int, int] | None = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if not rows.shape[1]:
                continue
            if long_list is not None:
                same = int(((rows[0] == long_list[0]) & (rows[1] == long_list[1])).sum())
                if same:
                    yield members(rows[:, :same])
                    rows = rows[:, same:]
                if not rows.shape[1]:
                    continue
                long_list = None
            held = np.concatenate([held, rows], axis=1)
            starts = np.flatnonzero(np.r_[True, (held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])])
            sizes = np.diff(np.r_[starts, held.shape[1]])
            many = np.repeat(sizes > limit, sizes)
            open_from = starts[-1]  # the last list may go on in the next batch
            done = np.arange(held.shape[1]) < open_from
            if (done & ~many).any():
                yield links(held[:, done & ~many])
            if (done & many).any():
                yield members(held[:, done & many])
            if many[-1]:
                long_list = (int(held[0, -1]), int(held[1, -1]))
                yield members(held[:, open_from:])
                held = held[:, :0]
            else:
                held = held[:, open_from:]
        if held.shape[1]:
            yield links(held)

    dealt = index.repartition(F.col("mask"), F.col("part")).sortWithinPartitions("mask", "part")
    return dealt.mapInArrow(run, "a long, b long, mask long")


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b): links that join every two fingerprints of `nodes` (fp, distinct) within the radius, directly or by steps."""
    if radius != 3:
        raise ValueError("the sets of the index are those of radius 3")
    first = F.array(*[F.lit(_signed(m)) for m in _first_masks()])
    found = stored(_linked(_index(nodes, first), radius, limit), "simhash-links")
    out = [found.filter("b is not null")]
    # the masks within a list, as a fixed small map: 20 masks of 3 bytes, 56 of 5
    level = _first_masks()
    for last in (False, True):
        finer = F.create_map(*[x for m in level for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(n)) for n in _next_masks(m)]))])
        # one fingerprint is listed once under a finer mask, from however many long lists it comes
        index = _index(found.filter("b is null").select(F.col("a").alias("fp"), "mask"), finer[F.col("mask")]).distinct()
        found = stored(_linked(index, radius, 1 << 13 if last else limit), "simhash-links")
        out.append(found.filter("b is not null"))
        level = sorted({n for m in level for n in _next_masks(m)})
    return out[0].unionByName(out[1]).unionByName(out[2]).select("a", "b")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS, limit: int = LIST_LIMIT) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id reachable over links."""
    rows = stored(fingerprints(df, id_column, text), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius, limit))
    # Both joins are on derived keys: their sides are fresh exchanges, which can be split at a hot fingerprint.
    placed = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "id"
    )
    named = placed.groupBy("root").agg(F.min("id").alias("component"))
    by_print = placed.select("fp", F.col("root").bitwiseXOR(F.lit(1)).alias("k")).join(
        named.select(F.col("root").bitwiseXOR(F.lit(1)).alias("k"), "component"), "k"
    ).select(F.col("fp").bitwiseXOR(F.lit(1)).alias("k"), "component")
    return rows.withColumn("k", F.col("fp").bitwiseXOR(F.lit(1))).join(by_print, "k").select("id", "fp", "component")


def report(df: DataFrame) -> DataFrame:
    """Per document its fingerprint in hexadecimal and its component."""
    return near_duplicates(df).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def one_of_each(df: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, among those of the smallest hash of the text.

    A missing id comes last. Rows alike in id and text are one; different texts under one id are not.
    """
    mark = F.xxhash64(text_of())
    name = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), mark.alias("mark"))
    groups = near_duplicates(df.select(name.alias("__name"), "text"), "__name").select("component").distinct()
    kept = groups.select(F.col("component.id").alias("__id"), F.col("component.mark").alias("__kept"))
    met = df.withColumn("__mark", mark).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__kept")), "left_semi")
    return met.dropDuplicates(["doc_id", "__mark"]).drop("__mark")
