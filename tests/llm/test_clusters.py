import hashlib
import math

import numpy as np
import pytest

from proofline.llm import clusters as C


def brute(rows, k=8, rounds=10, seed=3, dimensions=64):
    """The same with all distances and Python's own numbers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(1024 * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(p) for _, p in order[:k]]

    def assign():
        out = []
        for _, p in kept:
            d = [sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [p for (_, p), (a, _) in zip(kept, found, strict=True) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    total = sum(d for _, d in found)
    inertia = [sum(d for a, d in found if a == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, a, d, inertia[a], total, digest[a]) for (i, _), (a, d) in zip(kept, found, strict=True)], key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def result(df):
    return sorted([tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=str)


def test_against_all_distances(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) / 8 + (i % 5)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1])] * 3 + [(7, [0.5] * 64), (None, [0.25] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] + [0.0] * 63), (905, [float("-inf")] + [0.0] * 63), (906, [None] + [0.0] * 63)]
    assert result(C.report(table(spark, rows))) == brute(rows)


def test_ties_go_to_the_smaller_number():
    centroids = np.array([[0, 0], [4, 0], [0, 4], [4, 4], [0, 0]], np.int64)
    number, distance = C.Bisectors.of(centroids).nearest(np.array([[2, 2], [2, 0], [4, 2], [0, 0], [5, 5]], np.int64))
    assert number.tolist() == [0, 0, 1, 0, 3] and distance.tolist() == [8, 4, 4, 0, 2]


@pytest.mark.parametrize("span", [2, 50, (1 << 27) - 1])
def test_tournament_is_the_nearest(span):
    rng = np.random.default_rng(span)
    centroids, vectors = rng.integers(-span, span, (7, 64)), rng.integers(-span, span, (400, 64))
    number, distance = C.Bisectors.of(centroids).nearest(vectors)
    apart = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids.tolist()] for v in vectors.tolist()]
    assert number.tolist() == [d.index(min(d)) for d in apart] and distance.tolist() == [min(d) for d in apart]


def test_few_same_or_no_vectors(spark):
    same = [(i, [0.125] * 64) for i in range(20)]
    assert result(C.report(table(spark, same))) == brute(same)
    few = [(i, [i / 3] * 64) for i in range(3)]
    assert result(C.report(table(spark, few))) == brute(few)
    none = C.report(table(spark, [(1, None)]))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


def test_negative_sums_are_floored(spark):
    rows = [(i, [-0.0011 * (i % 3)] * 64) for i in range(50)]
    assert result(C.report(table(spark, rows))) == brute(rows)


def test_other_columns_and_sizes(spark):
    df = spark.createDataFrame([(i, [i / 2, -i / 4], "x", 5, b"p") for i in range(9)], "vec_id long, embedding array<float>, label string, cluster int, packed binary")
    got = C.cluster(df, k=2, rounds=3, dimensions=2)
    assert got.columns == ["vec_id", "label", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(got) == brute([(i, [i / 2, -i / 4]) for i in range(9)], 2, 3, 3, 2)


def test_components_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="a component of"):
        C.report(table(spark, [(1, [1e9] * 64)])).count()
