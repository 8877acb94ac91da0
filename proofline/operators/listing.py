"""Filtered, ordered and paged lists, and plain set operations.

A page is an ordered limit with an offset, which Spark runs as a top-k per task.
Every order ends with a unique column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import predicates as P
from proofline.functions.joins import side_by_side, split_join
from proofline.functions.text import non_empty
from proofline.operators.cases import case_members, days_since, followup_rows


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def list_recent(df: DataFrame, order: str, n: int, ident: str) -> DataFrame:
    """The `n` newest rows."""
    return df.orderBy(F.col(order).desc(), F.col(ident)).limit(n)


def top_failures(jobs: DataFrame, n: int = 10) -> DataFrame:
    return list_recent(jobs.where(F.col("status") == "FAILED"), "finished_at", n, "job_id")


def sorted_ids(df: DataFrame, column: str = "group_id") -> DataFrame:
    """Distinct present values in order."""
    value = non_empty(F.col(column)).alias(column)
    return df.select(value).where(F.col(column).isNotNull()).distinct().orderBy(column)


def new_ids(keys: DataFrame, existing: DataFrame) -> DataFrame:
    """Each distinct key with whether it is already present."""
    name = keys.columns[0]
    added = keys.subtract(existing).withColumn("outcome", F.lit("added"))
    present = keys.intersect(existing).withColumn("outcome", F.lit("already_present"))
    return added.unionByName(present).select(name, "outcome")


def _equal(df: DataFrame, **wanted: object) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def filter_evidence(
    submissions: DataFrame, report_status: str | None = None, readable: bool = False,
    requires_review: bool = False, start: dt.date | str | None = None, end: dt.date | str | None = None,
    evidence_id: object = None, application_id: str | None = None, processing_status: str | None = None,
    media_type: str | None = None,
) -> DataFrame:
    """Submissions meeting all given filters; count it for the total of a list."""
    rows = submissions.where(P.period_filter(F.col("received_at"), start, end))
    if report_status in ("SYNC_VISIBLE", "SYNC_REVIEW"):
        rows = rows.where(P.sync_visible() if report_status == "SYNC_VISIBLE" else P.sync_review())
    elif report_status in ("VALID", "PENDING", "DUPLICATE", "NOT_VALIDATED"):
        rows = rows.where(P.category() == report_status)
    elif report_status is not None:
        raise ValueError("unknown report status")
    if readable:
        rows = rows.where(P.readable_filter())
    if requires_review:
        rows = rows.where(F.col("processing_status") == "REQUIRES_REVIEW")
    return _equal(
        rows, evidence_id=evidence_id, application_id=application_id,
        processing_status=processing_status, media_type=media_type,
    )


def list_evidence(submissions: DataFrame, limit: int = 50, offset: int = 0, **filters: object) -> DataFrame:
    """One page, newest first."""
    return page(
        filter_evidence(submissions, **filters), [F.col("received_at").desc(), "evidence_id"], limit, offset
    )


def list_results(
    results: DataFrame, status: str | None = None, application_id: str | None = None,
    group_id: str | None = None, agent_id: object = None, locality: str | None = None,
    limit: int = 200, offset: int = 0,
) -> DataFrame:
    """One page of results; the group may stand on either side."""
    rows = _equal(results, status=status, application_id=application_id, agent_id=agent_id, locality=locality)
    if group_id is not None:
        rows = rows.where(
            (F.col("whatsapp_group_id") == group_id) | (F.col("dashboard_group_id") == group_id)
        )
    return page(rows, [F.col("evidence_id").asc_nulls_last(), F.col("row_id").asc_nulls_last()], limit, offset)


def list_cases(
    cases: DataFrame, submissions: DataFrame, attempts: DataFrame, now: dt.datetime | str,
    reference: object = None, state: str | None = None, view: str | None = None, delay: int = 0,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of cases by id, stored state, derived state of the report, or days since the last reminder."""
    rows = _equal(cases, case_evidence_id=reference, status=state)
    if view is not None or delay > 0:
        groups = followup_rows(cases, submissions, attempts)
        if view is not None:
            groups = groups.where(F.col("status") == view)
        if delay > 0:
            groups = groups.where(days_since(F.col("last_sent_at"), now) >= delay)
        members = case_members(cases, submissions).join(groups.select("group_key"), "group_key", "left_semi")
        rows = rows.join(members.select("case_evidence_id"), "case_evidence_id", "left_semi")
    return page(rows, [F.col("created_at").desc(), "case_evidence_id"], limit, offset)


def list_messages(
    messages: DataFrame, channel_id: object = None, download_status: str | None = None,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    """One page of messages, newest first. Unassigned and failed lists are the two status filters."""
    rows = _equal(messages, channel_id=channel_id, download_status=download_status)
    return page(rows, [F.col("message_date").desc(), "message_id", "evidence_id"], limit, offset)


def list_audit(audit: DataFrame, action: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(_equal(audit, action=action), [F.col("created_at").desc(), "audit_id"], limit, offset)


def search_channels(channels: DataFrame, text: str = "") -> DataFrame:
    """Channels whose name contains the text, any case, by name."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return channels.where(F.col("name").ilike(f"%{escaped}%")).orderBy("name", "channel_id")


def export_ids(
    submissions: DataFrame, app: str | None = None, start: dt.date | str | None = None,
    end: dt.date | str | None = None, detailed: bool = False,
) -> DataFrame:
    """Sorted distinct detected ids, or one line per submission with its origin.

    The detailed form needs the columns that `origin_lookup` adds.
    """
    rows = submissions.where(
        F.col("normalized_group_id").isNotNull() & P.period_filter(F.col("received_at"), start, end)
    )
    rows = P.effective_values(_equal(rows, application_id=app))
    if not detailed:
        return sorted_ids(rows)
    return rows.select(
        F.col("group_id").alias("detected_id"), F.col("application_id").alias("application"),
        F.col("channel_name").alias("channel"), F.coalesce("agent_name", "sender_name").alias("contact"),
        F.col("sender_phone").alias("phone"), F.col("sync_date").alias("detected_date"),
        F.col("sync_status").alias("status"),
        F.date_format("received_at", "yyyy-MM-dd HH:mm").alias("received"),
    )


def retention_plan(
    submissions: DataFrame, frames: DataFrame, jobs: DataFrame, now: dt.datetime | str,
    days: int = K.RETENTION_DAYS,
) -> DataFrame:
    """Paths that only old, settled submissions use: (path, removable, problem).

    A path any kept submission or frame also uses is left out. A path outside
    the allowed folders or types is listed with its problem and never removable.
    """
    text = now.isoformat(sep=" ") if isinstance(now, dt.datetime) else now
    limit = F.lit(text).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    active = jobs.where(F.col("status").isin(*K.TRANSITIONAL, "RUNNING")).select("evidence_id").where(
        "evidence_id IS NOT NULL"
    ).distinct().withColumn("has_job", F.lit(True))
    marked = submissions.join(active, "evidence_id", "left").select(
        "evidence_id", F.col("storage_path").alias("path"),
        ((F.col("received_at") < limit) & ~P.is_transitional() & F.col("has_job").isNull()).alias("old"),
    )
    owned = split_join(
        frames.select("evidence_id", F.col("storage_path").alias("path")),
        marked.select("evidence_id", "old"), ["evidence_id"],
    ).select("path", F.coalesce("old", F.lit(False)).alias("old"))
    # One aggregate decides a path: removable only if every owner is old.
    paths = marked.select("path", "old").unionByName(owned).where("path IS NOT NULL").groupBy("path").agg(
        F.bool_and("old").alias("all_old")
    ).where("all_old").drop("all_old")
    folder = F.split_part("path", F.lit("/"), F.lit(1))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    problem = (
        F.when(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "outside storage")
        .when(~folder.isin(*K.STORAGE_FOLDERS), "folder not allowed")
        .when(~suffix.isin(*K.IMAGE_EXTENSIONS, *K.VIDEO_EXTENSIONS), "type not allowed")
    )
    return paths.select("path", problem.isNull().alias("removable"), problem.alias("problem"))


def retention_summary(plan: DataFrame, submissions: DataFrame) -> DataFrame:
    """One row: files to remove, refused paths, submissions in all."""
    files = plan.agg(
        F.count_if("removable").alias("files"), F.count_if(~F.col("removable")).alias("refused")
    )
    return side_by_side(files, submissions.agg(F.count("*").alias("submissions")))
