"""Shards of near equal bytes from groups that stay whole: minimax contiguous partition.

Rows with equal texts form one group. Groups lie in the order of a hash of
their text, and the smallest capacity is sought for which cutting greedily
along that order needs no more than the allowed number of shards.

The order never passes through one task. It is cut into cells, of which the
driver sees only sums: at first `CELLS` of equal width, then `FINE` of each
cell that a cut may fall into. Two greedy checks bracket the answer at every
level: cells taken as whole give a capacity that surely works, cells taken as
divisible one below which none works. Where all cells at possible cuts hold a
single group the bracket closes, and the capacity is exact. A cut can be off by
one cell for every cut before it, so a level splits some shards^2 cells: what
the driver holds does not depend on the size of the table.

A missing text counts as the empty one. Rows with the same id are rows of
their own, each with its own slot. An empty table gives an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline.llm.common import stored, text_of

#: log2 of the number of cells at first, and of the cells that one of them is split into.
CELLS = 14
FINE = 4
OVERHEAD = 16
#: Rows of a shard that one task numbers, about.
NUMBERED = 50_000


class Cells:
    """Neighbouring ranges of the order as (first key, log2 of the width, bytes, bytes of the largest group, groups)."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = np.array([r[2] for r in self.rows], dtype=np.int64).cumsum()
        self.begins = np.r_[0, self.ends[:-1]]
        self.total = int(self.ends[-1])
        self.largest = max(r[3] for r in self.rows)

    def at(self, place: int) -> int:
        """The cell in which the byte at this place lies."""
        return int(np.searchsorted(self.ends, place, side="right"))

    def single(self, cell: int) -> bool:
        return self.rows[cell][4] == 1

    def cuts(self, capacity: int, shards: int, divisible: bool, stop: bool = True) -> list[int] | None:
        """Greedy cuts as running sums; None if more shards are needed. Without `stop`, cuts stay where no cell fits."""
        place, out = 0, []
        for _ in range(shards):
            if place + capacity >= self.total:
                return out
            cell = self.at(place + capacity)
            reached = place + capacity if divisible and not self.single(cell) else int(self.begins[cell])
            if reached <= place and stop:
                return None
            place = max(place, reached)
            out.append(place)
        return None if stop else out

    def smallest(self, low: int, high: int, shards: int, divisible: bool) -> int:
        """The smallest capacity in low..high with which the greedy check succeeds; high does."""
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, divisible) is None:
                low = middle + 1
            else:
                high = middle
        return high

    def unsure(self, low: int, high: int, shards: int) -> list[int]:
        """Cells of several groups in which a cut may fall for some capacity in low..high."""
        first = self.cuts(low, shards, divisible=False, stop=False)
        last = self.cuts(high, shards, divisible=True, stop=False)
        found: set[int] = set()
        for n, begin in enumerate(first):
            end = last[n] if n < len(last) else self.total - 1
            found.update(i for i in range(self.at(begin), self.at(min(end, self.total - 1)) + 1) if not self.single(i))
        return sorted(found)


def _summed(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
    cell = F.shiftright("key", bits).alias("cell")
    sums = groups.groupBy(cell).agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count(F.lit(1)).alias("g"))
    return [(r.cell << bits, bits, r.s, r.m, r.g) for r in sums.collect()]


def _finer(groups: DataFrame, cells: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The cells within the given (first key, log2 of the width) ranges."""
    by_width: dict[int, list[int]] = {}
    for low, bits in cells:
        by_width.setdefault(bits, []).append(low >> bits)
    out = []
    for bits, numbers in by_width.items():
        wanted = groups.sparkSession.createDataFrame([(n,) for n in numbers], "wanted long")
        inside = groups.join(F.broadcast(wanted), F.shiftright("key", bits) == F.col("wanted"), "left_semi")
        out += _summed(inside, max(0, bits - FINE))
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """For (key, bytes) groups, one row per key: the smallest capacity, and the first keys of shards 1, 2, and so on."""
    rows = _summed(groups, 64 - CELLS)
    if not rows:
        return 0, []
    while True:
        cells = Cells(rows)
        high = cells.smallest(cells.largest, cells.total, shards, divisible=False)
        low = cells.smallest(max(cells.largest, -(-cells.total // shards)), high, shards, divisible=True)
        unsure = set(cells.unsure(low, high, shards)) if low < high else set()
        if not unsure:
            return high, [cells.rows[cells.at(place)][0] for place in cells.cuts(high, shards, divisible=False)]
        rows = [r for i, r in enumerate(cells.rows) if i not in unsure]
        rows += _finer(groups, [cells.rows[i][:2] for i in sorted(unsure)])


def shard(df: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot): each row's shard, and its place in it from 0 without gaps."""
    body = text_of(f"`{text}`")
    rows = stored(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{id_column}`").alias("id"),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("crc"),
            F.xxhash64(body).alias("key"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, firsts = minimax_cuts(groups, shards)
    number = F.lit(0)
    for key in firsts:
        number = number + (F.col("key") >= F.lit(key)).cast("int")
    # Rows are numbered in runs of a shard; a table with a row per run says where each run begins.
    runs = max(1, rows.count() // (shards * NUMBERED))
    placed = rows.withColumn("shard", number).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)))
    counts = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        F.col("shard").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
    )
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("row")) - 1
    numbered = placed.withColumn("within", within)
    met = numbered.join(begins, (F.col("shard") == F.col("s")) & (F.col("run") == F.col("r")))
    return met.select("id", "size", "crc", "shard", (F.col("begin") + F.col("within")).cast("long").alias("slot"))


def report(df: DataFrame, shards: int) -> DataFrame:
    """Per document its size, checksum, shard and slot, under the law of near equal bytes."""
    return shard(df, shards).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
