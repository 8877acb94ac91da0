"""Connected components of a table of links, as joins and grouping over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node that has a link: root is the smallest node reachable. `links` has long columns a, b.

    Alternates the large-star and small-star steps until the links no longer change. Each step sends a node's
    neighbours to the smallest one it knows, so the number of rounds grows with the logarithm of the longest
    chain. A node's smallest neighbour comes from a hash aggregate and meets its links in a join that can be
    split, so a node with very many links fills no single task. Links to itself and repeated links change nothing.
    """
    current = stored(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    before = None
    while True:
        large = _star(current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        small = stored(_star(large, larger=False), label)
        # Both sums are over distinct links, so equal sums mean equal sets but for a chance of 2^-64.
        after = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        current = small
        if after == before:
            break
        before = after
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links every neighbour of a node (for large-star the larger ones, else all) to the node's smallest neighbour."""
    smallest = links.groupBy("a").agg(F.min("b").alias("m")).select(
        # a derived key makes both sides move, so that the join can be split at a node with many links
        F.col("a").bitwiseXOR(F.lit(1)).alias("k"), F.least("a", "m").alias("m")
    )
    met = links.withColumn("k", F.col("a").bitwiseXOR(F.lit(1))).join(smallest, "k")
    if larger:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            smallest.select(F.col("k").bitwiseXOR(F.lit(1)).alias("a"), F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()
