"""Join and grouping shapes shared by the operators.

No helper forces a broadcast: Spark broadcasts a side by its measured size
(`spark.sql.autoBroadcastJoinThreshold`, re-checked at run time by AQE) and
otherwise shuffles, splitting hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_BUCKETS = 1024


def text_key(columns: Sequence[str]) -> Column:
    """The key columns as one text, null standing for itself."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in columns]
    return F.concat_ws("\u0001", F.lit("k"), *parts)


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join on `keys` that keeps the left side's keys and can be split where a key is hot.

    AQE only splits a join whose two inputs are fresh exchanges. A side that was
    just aggregated by the same keys would be used in place, and the hot rows of
    the other side would all go to its task. Joining on a derived key makes both
    sides move; the aggregated one is the small one.
    """
    other = right.select(
        text_key(keys).alias("__key"), *[F.col(f"`{c}`") for c in right.columns if c not in keys]
    )
    joined = left.withColumn("__left", text_key(keys)).join(other, F.col("__left") == F.col("__key"), how)
    return joined.drop("__left", "__key")


def lookup(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on a text key to a side holding one row per key.

    Rows whose key is null match nothing, so they are spread over many buckets
    instead of meeting in one task. Hot keys can be split, as in `split_join`.
    """
    salted = F.concat(
        F.lit("\u0000"), F.pmod(F.xxhash64(F.col(spread_by)), F.lit(NULL_BUCKETS)).cast("string")
    )
    other = right.select(
        F.concat(F.lit("k"), F.col(key).cast("string")).alias("__key"),
        *[F.col(c) for c in right.columns if c != key],
    )
    met = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), salted) == F.col("__key")
    return left.join(other, met, "left").drop("__key")


def same(a: str, b: str, columns: Sequence[str]) -> Column:
    """Null-safe equality of columns of two aliased sides."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return condition


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the values of its first row in the given order.

    An aggregate rather than a window: each task first reduces its own rows, so
    a key holding much of the table costs no more than another.
    """
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(best).select(*keys, "__first.*")


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Joins aggregates of one row each into one row, without a cross join.

    The rows are stacked, and each column keeps its only value.
    """
    stacked = one_row[0]
    for part in one_row[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
