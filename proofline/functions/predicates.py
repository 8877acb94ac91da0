"""Predicates and derived columns of a submission.

They read the columns of the submission schema by name, so one
expression serves every operator. A submission without an extraction has null
extraction columns; every predicate then answers false rather than null.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.text import has_text, non_empty, present


def _col(name: str, alias: str | None) -> Column:
    return F.col(f"{alias}.{name}") if alias else F.col(name)


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def usable_filter(alias: str | None = None) -> Column:
    """Successful, finished and not a copy."""
    return _sure(
        (_col("sync_status", alias) == "SUCCESS")
        & _col("processing_status", alias).isin(*K.FINISHED)
        & _col("duplicate_of_id", alias).isNull()
    )


def is_duplicate(alias: str | None = None) -> Column:
    return _col("duplicate_of_id", alias).isNotNull() | _sure(
        _col("processing_status", alias) == "DUPLICATE"
    )


def is_transitional(alias: str | None = None) -> Column:
    return _sure(_col("processing_status", alias).isin(*K.TRANSITIONAL))


def readable_filter(min_conf: float = K.READABLE_CONFIDENCE) -> Column:
    return _sure(
        F.col("processing_status").isin(*K.FINISHED)
        & (F.col("confidence") >= min_conf)
        & (F.length(F.trim(F.col("raw_text"))) > 0)
    )


def effective_values(submissions: DataFrame) -> DataFrame:
    """Adds group_id and sync_date: the manual correction when there is one, else the read value."""
    return submissions.withColumns({
        "group_id": F.coalesce(non_empty(F.col("corrected_group_id")), F.col("normalized_group_id")),
        "sync_date": F.coalesce(non_empty(F.col("corrected_date")), F.col("normalized_date")),
    })


def category() -> Column:
    """One of DUPLICATE, PENDING, VALID, NOT_VALIDATED."""
    valid = _sure(F.col("processing_status").isin(*K.FINISHED) & (F.col("sync_status") == "SUCCESS"))
    return (
        F.when(is_duplicate(), "DUPLICATE")
        .when(is_transitional(), "PENDING")
        .when(valid, "VALID")
        .otherwise("NOT_VALIDATED")
    )


def sync_visible() -> Column:
    return ~is_duplicate() & ~is_transitional() & _sure(F.col("sync_status") == "SUCCESS")


def sync_review() -> Column:
    return sync_visible() & ~_sure(F.col("processing_status").isin(*K.FINISHED))


def report_category(submissions: DataFrame) -> DataFrame:
    return submissions.withColumns({
        "category": category(), "sync_visible": sync_visible(), "sync_review": sync_review(),
    })


def state() -> Column:
    return (
        F.when(is_duplicate(), "DUPLICATE")
        .when(usable_filter(), "SYNCHRONIZED")
        .when(is_transitional(), "PENDING")
        .when(_sure(F.col("sync_status") == "FAILED"), "FAILED")
        .when(_sure(F.col("sync_status") == "SUCCESS"), "REVIEW")
        .otherwise("UNCONFIRMED")
    )


def evidence_state(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn("state", state())


def dated() -> Column:
    """The report date can be trusted."""
    return present(F.col("sync_date")) & ~F.coalesce(F.col("date_is_ambiguous"), F.lit(True))


def day_columns() -> tuple[Column, Column]:
    """(day, basis): the report date, or the day of reception when it cannot be trusted."""
    received_day = F.to_date(F.col("received_at")).cast("string")
    return (
        F.when(dated(), F.col("sync_date")).otherwise(received_day),
        F.when(dated(), "report_date").otherwise("received_at_unverified"),
    )


def evidence_day(submissions: DataFrame) -> DataFrame:
    """Adds day and day_basis."""
    day, basis = day_columns()
    return submissions.withColumns({"day": day, "day_basis": basis})


def reason() -> Column:
    """Why a submission cannot be used, or null when it can or is not finished."""
    unreadable = ~has_text(F.col("raw_text")) | F.coalesce(
        F.col("confidence") < K.READABLE_CONFIDENCE, F.lit(True)
    )
    parts = F.array_compact(F.array(
        F.when(F.col("processing_status") == "FAILED", K.REASON_ANALYSIS),
        F.when(unreadable, K.REASON_UNREADABLE),
        F.when(~present(F.col("application_id").cast("string")), K.REASON_NO_APPLICATION),
        F.when(~present(F.col("group_id")), K.REASON_NO_GROUP),
        F.when(~dated(), K.REASON_NO_DATE),
        F.when(F.col("sync_status") == "FAILED", K.REASON_SYNC_FAILED)
        .when(F.coalesce(F.col("sync_status") != "SUCCESS", F.lit(True)), K.REASON_SYNC_UNCONFIRMED),
    ))
    text = F.coalesce(non_empty(F.array_join(parts, "; ")), F.lit(K.REASON_DEFAULT))
    return F.when(~(is_duplicate() | is_transitional() | usable_filter()), text)


def problem_reason(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn("reason", reason())


def _day(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def _instant(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def period_filter(
    col: Column, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> Column:
    """Both days included, as a half-open range that reaches the scan."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (col >= _instant(_day(start)))
    if end is not None:
        condition = condition & (col < _instant(_day(end) + dt.timedelta(days=1)))
    return condition


def claim_period_filter(
    date: Column, received: Column, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> Column:
    """In period by the report date; by reception only where there is no report date."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (
            (date >= _day(start).isoformat()) | (date.isNull() & period_filter(received, start=start))
        )
    if end is not None:
        condition = condition & (
            (date <= _day(end).isoformat()) | (date.isNull() & period_filter(received, end=end))
        )
    return condition


def cutoff_filter(ts: Column, cutoff: dt.datetime | str) -> Column:
    """Older than the reset instant."""
    text = cutoff.isoformat(sep=" ") if isinstance(cutoff, dt.datetime) else cutoff
    return _sure(ts < F.lit(text).cast("timestamp_ntz"))
