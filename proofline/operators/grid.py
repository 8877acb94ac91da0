"""Expected ids of a project against the proofs received, per calendar bucket."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import predicates as P
from proofline.functions.joins import side_by_side
from proofline.functions.text import business_key

BUCKET_DAYS = {"daily": 1, "weekly": 7}


def _bucket_days(start: dt.date, end: dt.date, cadence: str) -> int:
    return BUCKET_DAYS.get(cadence, (end - start).days + 1)


def bucket_of(received: Column, start: dt.date, days: int) -> Column:
    """Number of the bucket a reception falls in; buckets run from `start`."""
    return F.floor(F.datediff(F.to_date(received), F.lit(start.isoformat()).cast("date")) / days).cast("int")


def project_submissions(
    submissions: DataFrame, messages: DataFrame, project_channels: DataFrame, project: object,
    start: dt.date, end: dt.date, app: str | None = None,
) -> DataFrame:
    """Submissions received in the period through a channel of the project."""
    channels = project_channels.where(F.col("project_id") == project).select("channel_id")
    linked = messages.where(F.col("evidence_id").isNotNull()).join(channels, "channel_id", "left_semi")
    rows = submissions.where(P.period_filter(F.col("received_at"), start, end))
    if app is not None:
        rows = rows.where(F.col("application_id") == app)
    return rows.join(linked.select("evidence_id"), "evidence_id", "left_semi")


def _identified() -> Column:
    return (business_key(F.col("group_id")) != "") & F.coalesce(F.col("application_id") != "", F.lit(False))


def project_grid(
    expected: DataFrame, received: DataFrame, start: dt.date, end: dt.date,
    cadence: str = "period", app: str | None = None,
) -> DataFrame:
    """One row per expected id and bucket: MISSING, VALID or RECEIVED_NOT_VALIDATED.

    Receipts are given their bucket number and counted before the join, so the
    range condition is an equality and the join sees one row per id and bucket.
    """
    days = _bucket_days(start, end, cadence)
    buckets = -(-((end - start).days + 1) // days)
    wanted = expected if app is None else expected.where(F.col("application_id") == app)
    grid = wanted.select("application_id", "business_id").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    )
    counts = received.where(~P.is_duplicate() & _identified()).groupBy(
        "application_id", business_key(F.col("group_id")).alias("business_id"),
        bucket_of(F.col("received_at"), start, days).alias("bucket"),
    ).agg(F.count("*").alias("received"), F.count_if(P.usable_filter()).alias("valid"))
    first = F.date_add(F.lit(start.isoformat()).cast("date"), F.col("bucket") * days)
    last = F.least(F.date_add(first, days - 1), F.lit(end.isoformat()).cast("date"))
    received_count = F.coalesce("received", F.lit(0))
    valid_count = F.coalesce("valid", F.lit(0))
    return grid.join(counts, ["application_id", "business_id", "bucket"], "left").select(
        "business_id", "application_id", first.cast("string").alias("start"), last.cast("string").alias("end"),
        received_count.alias("received"), valid_count.alias("valid"),
        F.when(received_count == 0, "MISSING").when(valid_count > 0, "VALID")
        .otherwise("RECEIVED_NOT_VALIDATED").alias("status"),
    )


def project_by_application(received: DataFrame) -> DataFrame:
    copy = P.is_duplicate()
    return received.groupBy("application_id").agg(
        F.count("*").alias("received"),
        F.count_if(~copy & P.usable_filter()).alias("valid"),
        F.count_if(copy).alias("duplicates"),
        F.count_if(~copy & ~_identified()).alias("unidentified"),
    )


def project_totals(received: DataFrame, grid: DataFrame) -> DataFrame:
    """One row: received, valid, duplicates, unidentified, expected, missing."""
    totals = project_by_application(received).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "valid", "duplicates", "unidentified")
    ])
    expected = grid.agg(
        F.count("*").alias("expected"), F.count_if(F.col("status") == "MISSING").alias("missing")
    )
    return side_by_side(totals, expected)


def channel_links(channels: DataFrame, links: DataFrame) -> DataFrame:
    """Every channel with its project, or null, by name."""
    owned = links.select("channel_id", "project_id")
    return channels.select("channel_id", "name").join(owned, "channel_id", "left").orderBy("name", "channel_id")


def channel_conflict(requested: DataFrame, links: DataFrame, project: object) -> DataFrame:
    """Requested channels that another project already owns."""
    taken = links.where(F.col("project_id") != project).select("channel_id")
    return requested.join(taken, "channel_id", "left_semi")
