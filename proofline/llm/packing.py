"""Token ids packed into rows of fixed length: best fit decreasing, with a segment tree over free space.

Documents become ids with an end mark. Those longer than a row are split into
pieces, of which all but the last are full rows; joined again they are the
document. Pieces are dealt by hash into groups of about `GROUP` documents or
`GROUP_BYTES` of text, whichever are more groups, and each group is packed on its
own in memory: longest first, each piece into the row with the least space that
is enough. A segment tree over the amounts of free space finds it in the
logarithm of the row length. Pieces of one length go by document id, then by
hash of the row and place; of rows with the same space the one used last is
taken. Repeats of a row are told apart by their number within a task, so that
they do not meet in one group.

A packed row has the ids (padded with the end mark), the cumulative lengths of
its segments, and position numbers that begin anew with each segment. Ids and
positions are little-endian binary of the narrowest width that holds them. A
missing or empty text is a document with the end mark alone. Repeated rows are
packed as often as they occur. Texts of any length are encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import sent, slices, small_batches

LENGTH = 2048
GROUP = 4096
GROUP_BYTES = 16_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ranks_of(path: str) -> dict[bytes, int]:
    """The merge ranks of a byte-level vocabulary file; they travel with the tasks (under a megabyte)."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def narrowest(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


class Space:
    """Rows by free space: the smallest free space that is at least a length, by a segment tree of which spaces occur."""

    def __init__(self, length: int):
        self.base = 1
        while self.base <= length:
            self.base *= 2
        self.largest = [-1] * (2 * self.base)  # of the free spaces in each range
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _set(self, space: int, value: int) -> None:
        at = self.base + space
        self.largest[at] = value
        while at > 1:
            at //= 2
            value = max(self.largest[2 * at], self.largest[2 * at + 1])
            if self.largest[at] == value:
                break
            self.largest[at] = value

    def put(self, row: int, space: int) -> None:
        if not self.rows[space]:
            self._set(space, space)
        self.rows[space].append(row)

    def take(self, length: int) -> tuple[int, int] | None:
        """(row, its free space) with the least space that is enough, or None."""
        if self.largest[1] < length:
            return None
        # up to the first range to the right that has a space, then down its left side
        at = self.base + length
        if self.largest[at] < length:
            while at % 2 or self.largest[at + 1] < length:
                at //= 2
            at += 1
            while at < self.base:
                at = 2 * at if self.largest[2 * at] >= length else 2 * at + 1
        space = at - self.base
        row = self.rows[space].pop()
        if not self.rows[space]:
            self._set(space, -1)
        return row, space


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of places of pieces; `lengths` come in falling order."""
    space, rows = Space(length), []
    for i, size in enumerate(lengths):
        found = space.take(size)
        if found is None:
            rows.append([i])
            row, free = len(rows) - 1, length
        else:
            row, free = found
            rows[row].append(i)
        if free > size:
            space.put(row, free - size)
    return rows


def pieces(df: DataFrame, ranks: dict[bytes, int], pattern: str, end: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, key, copy, piece, n, ids): every document's ids in pieces of at most `length`.

    `key` is a hash of the row, `copy` is 0 unless the row came before in the same task.
    """
    small_batches(df.sparkSession)
    model, _ = sent(df.sparkSession, (ranks, pattern))
    width = narrowest(max(end, max(ranks.values(), default=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        seen: dict[int, int] = {}
        own = tiktoken.Encoding("own", pat_str=model()[1], mergeable_ranks=model()[0], special_tokens={})
        for batch in slices(batches, "text"):
            source, piece, sizes, ids = [], [], [], []
            copies = []
            for key in batch.column(1).to_pylist():
                before = seen.get(key, 0)
                seen[key] = before + 1
                copies.append(task + before if before else 0)
            copy = pa.array(copies, pa.int64())
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = np.array([*own.encode_ordinary(text), end], dtype=width)
                for n, begin in enumerate(range(0, len(found), length)):
                    part = found[begin : begin + length]
                    source.append(i), piece.append(n), sizes.append(len(part)), ids.append(part.tobytes())
            at = pa.array(source, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), copy.take(at), pa.array(piece, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary())],
                ["doc_id", "key", "copy", "piece", "n", "ids"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    plain = df.select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, key long, copy long, piece int, n int, ids binary")


def pack(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, end: int, length: int = LENGTH, group: int = GROUP,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(pack_group, pack, n_tokens, doc_ids, pieces, cu_seqlens, input_ids, position_ids), a row for each packed row."""
    small_batches(df.sparkSession)
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-rows // group), -(-size // group_bytes))
    width = narrowest(max(end, max(ranks.values(), default=0)))
    positions = np.arange(length, dtype=narrowest(length))
    kind = df.schema["doc_id"].dataType.simpleString()

    def packed(number: int, columns: list[list]) -> pa.RecordBatch:
        doc, piece, sizes, ids = columns
        rows = best_fit(sizes, length)
        lengths = [[sizes[i] for i in row] for row in rows]
        fill = np.full(length, end, dtype=width).tobytes()
        unit = len(fill) // length
        matrix = [b"".join([*(ids[i] for i in row), fill[: unit * (length - sum(own))]]) for row, own in zip(rows, lengths, strict=True)]
        place = [
            b"".join([*(positions[:n].tobytes() for n in own), positions[: length - sum(own)].tobytes()]) for own in lengths
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array([sum(own) for own in lengths], pa.int32()),
                pa.array([[doc[i] for i in row] for row in rows]), pa.array([[piece[i] for i in row] for row in rows], pa.list_(pa.int32())),
                pa.array([[0, *np.cumsum(own).tolist()] for own in lengths], pa.list_(pa.int32())), pa.array(matrix, pa.binary()), pa.array(place, pa.binary()),
            ],
            ["pack_group", "pack", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, [[], [], [], []]
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for begin, stop in zip(cuts, cuts[1:], strict=False):
                if begin == stop:
                    continue
                if number is not None and int(own[begin]) != number:
                    yield packed(number, held)
                    held = [[], [], [], []]
                number = int(own[begin])
                for into, column in zip(held, batch.columns[1:], strict=True):
                    into.extend(column.slice(begin, stop - begin).to_pylist())
        if number is not None:
            yield packed(number, held)

    cut = pieces(df, ranks, pattern, end, length)
    dealt = cut.select(F.pmod(F.xxhash64("key", "copy", "piece"), F.lit(groups)).cast("int").alias("pack_group"), "doc_id", "piece", "n", "ids", "key")
    dealt = dealt.repartition("pack_group").sortWithinPartitions("pack_group", F.desc("n"), "doc_id", "key", "piece").drop("key")
    schema = f"pack_group int, pack int, n_tokens int, doc_ids array<{kind}>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
    return dealt.mapInArrow(run, schema)


def write(packed_rows: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet, one matrix row for each record."""
    packed_rows.write.parquet(path)
