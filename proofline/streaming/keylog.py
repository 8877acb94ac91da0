"""Keys that earlier batches of a stream have met, kept so that no key is forgotten and a batch reads little.

Each batch writes its new keys as a run: rows dealt to hash buckets, sorted by
hash, and for each bucket a filter of some ten bits a key. Runs of successive
batches are merged, a fixed number at a time, so their number grows with the
logarithm of the number of batches. A batch asks the filters first and then
reads, of all runs, the buckets that may hold one of its keys; an equality join
decides. Nothing is held in memory between batches.

Which runs a batch reads follows from its number alone, and a run is in place
once its filters are, so a batch that is repeated finds what it found before and
writes the same again.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of a filter for each key, and how many of them a key sets: about one foreign key in a hundred passes.
BITS, MARKS = 10, 7
#: Keys that ask one filter in one task, about.
ASKED = 200_000
#: A merged run covers at most this many batches, so that no merge grows with the stream.
LONGEST = 4096


@dataclass(frozen=True)
class Run:
    """The batches from `first` to `last`."""

    first: int
    last: int
    path: str


def hashed(key: str) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")))


def marks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places each hash sets in a filter, one row for each hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    steps = np.arange(MARKS, dtype=np.uint64)
    return (low[:, None] + steps * high[:, None]) % np.uint64(bits)


def _hashes(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def filter_of(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-BITS * hashes.size // 64) * 64)
    held = np.zeros(bits, dtype=bool)
    held[marks(hashes, bits).ravel()] = True
    return np.packbits(held).tobytes()


def may_hold(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash: never false for one that it does."""
    held = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    return held[marks(hashes, held.size)].all(axis=1)


class KeyLog:
    """The keys of earlier batches, each with its values.

    `rows` is about how many keys a bucket holds; `fan` how many runs become one.
    Keys are compared as text; a missing key is a key of its own.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, values: Sequence[str] = (), rows: int = 100_000, fan: int = 8):
        self.spark, self.root, self.key, self.values = spark, root, key, list(values)
        self.rows, self.fan = rows, fan
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._files.exists(self._hadoop(path))

    def _runs(self) -> list[Run]:
        """All runs in place."""
        if not self._exists(self.root):
            return []
        found = []
        for status in self._files.listStatus(self._hadoop(self.root)):
            name = status.getPath().getName()
            if name.startswith("run-") and self._exists(f"{self.root}/{name}/filters/_SUCCESS"):
                first, last = map(int, name.removeprefix("run-").split("-"))
                found.append(Run(first, last, f"{self.root}/{name}"))
        return found

    def before(self, batch_id: int, shorter: int | None = None) -> list[Run]:
        """The fewest runs that hold all batches before this one, of those `shorter` than so many batches if given."""
        runs = [r for r in self._runs() if r.last < batch_id and (shorter is None or r.last - r.first + 1 < shorter)]
        out, at = [], 0
        for run in sorted(runs, key=lambda r: (r.first, -r.last)):
            if run.first >= at:
                out.append(run)
                at = run.last + 1
        return out

    def touched(self, keys: DataFrame, batch_id: int) -> list[str]:
        """The buckets of earlier runs that may hold one of the keys. Runs a job; there are no more than buckets."""
        runs = self.before(batch_id)
        if not runs:
            return []
        filters = self.spark.read.parquet(*[f"{r.path}/filters" for r in runs])
        sizes = filters.groupBy("run").agg(F.max("buckets").alias("buckets"))
        asked = keys.select(hashed(self.key).alias("hash")).distinct()
        parts = max(1, -(-asked.count() // ASKED))
        # one row for each key and run; a key's part spreads the askers of a filter over tasks
        asked = asked.withColumn("part", F.pmod(F.shiftright("hash", 17), F.lit(parts)).cast("int")).withColumn(
            "run", F.explode(F.array(*[F.lit(r.first).cast("bigint") for r in runs]))
        ).join(sizes, "run").select("run", F.pmod("hash", "buckets").cast("int").alias("bucket"), "part", "hash")
        filters = filters.select("run", "bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            hit = left.num_rows and right.num_rows and may_hold(right["bits"][0].as_py(), _hashes(left["hash"])).any()
            return left.select(["run", "bucket"]).slice(0, 1 if hit else 0)

        by = ["run", "bucket", "part"]
        hits = asked.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(ask, "run bigint, bucket int").distinct().collect()
        paths = {r.first: r.path for r in runs}
        return sorted(f"{paths[h.run]}/rows/bucket={h.bucket}" for h in hits)

    def earlier(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """(key, values) of each of the keys that a batch before this one holds."""
        kind = [f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields if f.name == self.key]
        paths = self.touched(keys, batch_id)
        if not paths:
            return keys.select(self.key).limit(0) if not self.values else self.spark.createDataFrame(
                [], ", ".join(kind + [f"`{v}` {self._kinds()[v]}" for v in self.values])
            )
        rows = self.spark.read.parquet(*paths).select("hash", self.key, *self.values)
        asked = keys.select(F.col(self.key).alias("__asked"), hashed(self.key).alias("__hash")).distinct()
        met = (F.col("hash") == F.col("__hash")) & F.col(self.key).eqNullSafe(F.col("__asked"))
        return rows.join(asked, met, "left_semi").select(self.key, *self.values)

    def _kinds(self) -> dict[str, str]:
        """Types of the values, from any run."""
        runs = self._runs()
        if not runs:
            return dict.fromkeys(self.values, "string")
        fields = self.spark.read.parquet(f"{runs[0].path}/rows").schema.fields
        return {f.name: f.dataType.simpleString() for f in fields}

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        path = f"{self.root}/run-{first:010d}-{last:010d}"
        rows = rows.select(hashed(self.key).alias("hash"), self.key, *self.values)
        buckets = 1
        while buckets * self.rows < rows.count():
            buckets *= 2
        dealt = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
        dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "hash").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{path}/rows")

        def build(group: pa.Table) -> pa.Table:
            return pa.table({
                "run": pa.array([first], pa.int64()), "bucket": group["bucket"].slice(0, 1).cast(pa.int32()),
                "buckets": pa.array([buckets], pa.int32()), "bits": pa.array([filter_of(_hashes(group["hash"]))], pa.binary()),
            })

        dealt.select("bucket", "hash").groupBy("bucket").applyInArrow(
            build, "run bigint, bucket int, buckets int, bits binary"
        ).write.mode("overwrite").parquet(f"{path}/filters")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Keeps new keys of a batch, each once, and merges runs that are due. `rows` should be stored, as it is read again."""
        for run in self._runs():
            # what a larger run has taken over; batches before this one are not repeated any more
            if any(o.first <= run.first and run.last <= o.last < batch_id and o != run for o in self._runs()):
                self._files.delete(self._hadoop(run.path), True)
        self._write(rows, batch_id, batch_id)
        size = self.fan
        while size <= LONGEST and (batch_id + 1) % size == 0:
            first = batch_id + 1 - size
            # a repeated batch finds the merged run in place, and merges the shorter ones once more
            parts = [r for r in self.before(batch_id + 1, shorter=size) if first <= r.first]
            rows = [self.spark.read.parquet(f"{r.path}/rows").select(self.key, *self.values) for r in parts]
            self._write(reduce(DataFrame.unionByName, rows), first, batch_id)
            size *= self.fan
