"""Centroid clustering by a bisector tournament, in whole numbers.

For each pair of centroids a < b the integer normal 2 * (b - a) and the threshold
|b|^2 - |a|^2 are worked out beforehand: a vector lies nearer to b exactly where
its product with the normal exceeds the threshold. So k - 1 sign tests, each of
the one still standing against the next centroid, leave the nearest; zero keeps
the smaller number. Only then is a distance taken, exactly, to the winner.

Vectors are scaled, floored and packed once and stored. Each round maps over them
and sums counts, distances and components within a task; what reaches the driver
is k rows of sums, whatever the number of vectors.

Vectors that are null, of another length, or with a null, infinite or NaN
component are left out. Repeated rows count each time. Missing vec_ids are kept
(in the hash as the empty text). With fewer vectors than centroids there are as
many centroids as vectors; an empty table gives an empty result. A component of
2^27 or more after scaling raises an error, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.common import stored

#: Components stay below this, so that 64 squared differences, and the products with normals, fit 64 bits.
LIMIT = 1 << 27
#: Dimensions up to which that holds.
DIMENSIONS = 64
#: Vectors worked on at once.
ROWS = 8192
COUNT, INERTIA = -2, -1

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def packed(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """Replaces the vector by `packed`: floor(scale * x) + LIMIT of each component in four bytes, whose order is that of the numbers.

    Vectors not whole are left out.
    """
    if not 0 < dimensions <= DIMENSIONS:
        raise ValueError(f"1 to {DIMENSIONS} dimensions")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (vector, "packed")]
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in (vector, "packed")], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            rows = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimensions)
            flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            whole = np.isfinite(values).all(axis=1)
            numbers = np.floor(values[whole] * scale)
            if numbers.size and np.abs(numbers).max() >= LIMIT:
                raise ValueError(f"a component of {LIMIT // scale} or more")
            numbers = (numbers + LIMIT).astype(">u4")
            rest = batch.take(pa.array(rows[whole])).columns[1:]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([n.tobytes() for n in numbers], pa.binary())], schema.names)

    return df.select(F.col(f"`{vector}`").alias("__vector"), *kept).mapInArrow(run, schema)


@dataclass
class Bisectors:
    """The integer normals and thresholds of all pairs of centroids."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Bisectors:
        squares = (centroids * centroids).sum(axis=1)
        return cls(centroids, 2 * (centroids[None] - centroids[:, None]), squares[None] - squares[:, None])

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it."""
        standing = np.zeros(len(vectors), np.int64)
        for rival in range(1, len(self.centroids)):
            # those that stand for the same centroid share a bisector
            for held in range(rival):
                rows = np.flatnonzero(standing == held)
                if rows.size:
                    sides = vectors[rows] @ self.normals[held, rival]
                    standing[rows[sides > self.thresholds[held, rival]]] = rival
        apart = vectors - self.centroids[standing]
        return standing, np.einsum("ij,ij->i", apart, apart)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u4").astype(np.int64) - LIMIT


def _vectors(batch: pa.RecordBatch, column: int, dimensions: int) -> np.ndarray:
    return _numbers(b"".join(batch.column(column).to_pylist())).reshape(-1, dimensions)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, dict[int, int]]:
    """Per centroid with vectors: at COUNT how many are nearest to it, at INERTIA the sum of their distances, then the sum of each component."""
    k, dimensions = centroids.shape
    bisectors = Bisectors.of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, 2 + dimensions), dtype=object)  # numbers of Python: distances may be large
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                values = _vectors(batch.slice(begin, ROWS), 0, dimensions)
                cluster, distance = bisectors.nearest(values)
                for c in np.unique(cluster).tolist():
                    own = cluster == c
                    totals[c] += [int(own.sum()), sum(distance[own].tolist()), *values[own].sum(axis=0).tolist()]
        rows = [(c, i - 2, totals[c, i]) for c in range(k) for i in range(2 + dimensions) if totals[c, 0]]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["cluster", "place", "total"])

    parts = vectors.select("packed").mapInArrow(run, "cluster int, place int, total decimal(38,0)")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        found.setdefault(r.cluster, {})[r.place] = int(r.total)
    return found


def first_centroids(vectors: DataFrame, k: int, seed: int, vec_id: str = "vec_id") -> np.ndarray:
    """The k vectors with the smallest hash of seed and id; equal hashes go by their components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{vec_id}`").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("hash"), "packed").orderBy("hash", "packed").limit(k).collect()
    return np.array([_numbers(bytes(r.packed)) for r in rows], np.int64)


def cluster(
    df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = DIMENSIONS, scale: int = 1024,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Every whole vector's row, less the vector, with its `cluster`, `distance` (squared), the inertia of its cluster and of all, and the hash of its final centroid.

    Runs one job for each round while it is built. Sums that do not fit a long come as null.
    """
    vectors = stored(packed(df, dimensions, scale, vector), "vectors")
    centroids = first_centroids(vectors, k, seed, vec_id)
    found = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    fields = [f for f in vectors.schema.fields if f.name != "packed" and f.name not in names]
    kept = [f.name for f in fields]
    if not len(centroids):
        added = [F.lit(None).cast(t).alias(n) for n, t in zip(names, ("int", "long", "long", "long", "string"), strict=True)]
        return vectors.select(*[F.col(f"`{c}`") for c in kept], *added)
    for _ in range(rounds):
        for number, sums in _sums(vectors, centroids).items():
            centroids[number] = [sums[i] // sums[COUNT] for i in range(dimensions)]
    bisectors = Bisectors.of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                number, distance = bisectors.nearest(_vectors(part, 0, dimensions))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(number, pa.int32()), pa.array(distance, pa.int64())], [*kept, "cluster", "distance"])

    assigned = vectors.select("packed", *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, T.StructType([*fields, *found]))
    inertia = {number: sums[INERTIA] for number, sums in _sums(vectors, centroids).items()}
    number = F.col("cluster") + 1

    def long(value: int):
        return F.lit(value if value < 1 << 63 else None).cast("long")

    return assigned.select(
        *[F.col(f"`{c}`") for c in kept], "cluster", "distance",
        F.element_at(F.array(*[long(inertia.get(c, 0)) for c in range(len(centroids))]), number).alias("cluster_inertia"),
        long(sum(inertia.values())).alias("inertia"),
        F.element_at(F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids]), number).alias("centroid_sha256"),
    )


def report(df: DataFrame) -> DataFrame:
    """Eight centroids, ten rounds, over all vectors of 64 components."""
    return cluster(df.select("vec_id", "embedding"))


def _oracle(k: int = 8, rounds: int = 10) -> str:
    """The same in SQL: each round takes all k distances."""
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p"
        " FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p FROM"
        f" (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, p FROM v ORDER BY h, p LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT v.r, c.c,"
            " CAST(list_sum(list_transform(range(1, 65), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i]))) AS BIGINT) AS d"
            f" FROM v CROSS JOIN c{i} c) GROUP BY r)"
        )
        if i < rounds:
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.p, o.p) AS p FROM c{i} o LEFT JOIN (SELECT c, list(m ORDER BY i) AS p FROM"
                " (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT a.c, t.i, sum(v.p[t.i]) AS s, count(*) AS n"
                f" FROM v JOIN a{i} a USING (r), range(1, 65) t(i) GROUP BY a.c, t.i)) GROUP BY c) n USING (c))"
            )
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,"
        " CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,"
        " sha256(array_to_string(c.p, ',')) AS centroid_sha256"
        f" FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c USING (c)"
    )


ORACLE = _oracle()
