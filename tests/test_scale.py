"""Shapes that must hold on a cluster: hot keys are split, rows are reduced before they move."""

import re

import pytest
from pyspark.sql import functions as F

from proofline.functions.joins import lookup
from proofline.operators import matching, reconcile, timeline, windows

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
}


@pytest.fixture
def cluster_like(spark):
    """No broadcasts, and partitions count as skewed at test size."""
    before = {k: spark.conf.get(k) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def hot_files(spark, n=120_000):
    """A third of the files share one content."""
    return spark.range(n).select(
        F.col("id").alias("evidence_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("received_at"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("sha256"),
        F.repeat(F.md5(F.col("id").cast("string")), 4).alias("payload"),
    )


def test_hot_content_is_split_and_whole(cluster_like, tmp_path):
    out = windows.content_dedup(hot_files(cluster_like).repartition(8), "sha256")
    out.write.parquet(str(tmp_path / "out"))
    back = cluster_like.read.parquet(str(tmp_path / "out"))
    assert back.count() == 120_000
    assert back.where("duplicate_of_id IS NOT NULL").count() == 39_999
    assert back.where("duplicate_of_id IS NOT NULL AND duplicate_of_id <> 0").count() == 0
    # The hot join key is read by several tasks.
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan, plan


def test_null_keys_do_not_meet_in_one_task(cluster_like):
    left = cluster_like.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("k"))
    right = cluster_like.createDataFrame([("0", "x"), ("10", "y")], "k string, v string")
    out = lookup(left, right, "k", "id")
    assert out.where("v IS NOT NULL").count() == 2 and out.count() == 20_000
    cluster_like.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        cluster_like.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(sizes) < 20_000 / 2


def test_hot_report_is_matched_slot_by_slot(cluster_like):
    rows = cluster_like.range(60_000).select(
        F.col("id").alias("evidence_id"), F.lit("hot").alias("key"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("received_at"),
    )
    bad, good = rows.where("evidence_id % 7 <> 0"), rows.where("evidence_id % 700 = 0")
    out = timeline.asof_forward_match(bad, good, ["key"])
    wrong = out.where(F.col("replacement_id") != F.ceil(F.col("evidence_id") / 700) * 700).count()
    assert wrong == 0
    last = 59_999 // 700 * 700
    assert out.count() == bad.where(F.col("evidence_id") <= last).count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(key#\d+, __slot#\d+", plan)


def within_a_second(spark, n=40_000):
    """Rows of one key, 25 microseconds apart."""
    return spark.range(n).select(
        F.col("id").alias("evidence_id"), F.concat(F.lit("hot"), F.col("id") % 1).alias("key"),
        F.timestamp_micros(1_700_000_000_000_000 + F.col("id") * 25).cast("timestamp_ntz").alias("received_at"),
    )


def test_a_key_within_one_second_is_spread(cluster_like):
    rows = within_a_second(cluster_like)
    out = timeline.asof_forward_match(rows.where("evidence_id % 7 <> 0"), rows.where("evidence_id % 700 = 0"), ["key"])
    assert out.where(F.col("replacement_id") != F.ceil(F.col("evidence_id") / 700) * 700).isEmpty()
    states = rows.withColumn("state", F.floor(F.col("evidence_id") / 900) % 3)
    changed = windows.state_changes(states, "key", "received_at", "state", "evidence_id")
    assert sorted(r["evidence_id"] for r in changed.collect()) == list(range(0, 40_000, 900))
    for plan in (out, changed):
        assert re.search(r"hashpartitioning\(key#\d+, __slot#\d+, __fine#\d+", plan._jdf.queryExecution().executedPlan().toString())


def test_one_instant_of_a_key_is_one_row_before_it_is_ordered(cluster_like):
    when = F.lit("2026-07-01 10:00:00").cast("timestamp_ntz")
    rows = within_a_second(cluster_like, 20_000).withColumn("received_at", when)
    out = timeline.asof_forward_match(rows.where("evidence_id % 2 = 0"), rows.where("evidence_id % 2 = 1"), ["key"])
    assert out.count() == 10_000 and out.where("replacement_id <> 1").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(__id" in plan[plan.rindex("Window ["):]
    none = rows.withColumn("received_at", F.lit(None).cast("timestamp_ntz"))
    assert timeline.asof_forward_match(none, rows, ["key"]).isEmpty() and timeline.asof_forward_match(rows, none, ["key"]).isEmpty()


def test_top_readings_are_limited_before_the_shuffle(spark):
    readings = spark.range(1000).select(
        (F.col("id") % 3).alias("proof_id"), F.col("id").alias("reading_id"), F.lit("t").alias("text"), F.rand(1).alias("confidence")
    )
    plan = windows.best_reading(readings)._jdf.queryExecution().executedPlan().toString()
    limit = plan.index("WindowGroupLimit")
    assert "Partial" in plan[limit:] and plan.rindex("WindowGroupLimit") > plan.index("Exchange", limit)


def test_claims_meet_ledger_dates_and_not_ledger_rows(spark, submissions):
    subs = submissions(dict())
    ledger = spark.createDataFrame([(1, "a", "gr1.a", "2026-07-30")], "row_id bigint, application_id string, group_id string, sync_date string")
    plan = reconcile.nearest_date_match(subs, ledger)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # Ledger rows are counted down to dates before they are ordered.
    window = plan.index("Window [")
    assert "partial_min(row_id" in plan[window:]


def test_similarity_join_is_an_equality_join(spark):
    words = spark.createDataFrame([("gr1.zone",)], "id string")
    plan = matching.fuzzy_id_match(words, words)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
