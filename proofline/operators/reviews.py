"""Manual corrections and decisions applied to submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.joins import split_join
from proofline.functions.text import non_empty, present

ORDER = ["at_time", "event_id"]


def _prepared(events: DataFrame) -> DataFrame:
    """Fields only a correction may set, blank ones treated as not given; a unique order per submission."""
    correct = F.col("kind") == "correct"
    app = F.col("new_application") if "new_application" in events.columns else F.lit(None).cast("string")
    ident = F.col("event_id") if "event_id" in events.columns else F.xxhash64("kind", "new_group", "new_date")
    return events.select(
        "evidence_id", "at_time", ident.alias("event_id"), "kind",
        F.when(correct, non_empty(F.col("new_group"))).alias("new_group"),
        F.when(correct, non_empty(F.col("new_date"))).alias("new_date"),
        F.when(correct, app).alias("new_application"),
        F.when(F.col("kind") == "status", F.col("new_status")).alias("new_status"),
    )


def apply_reviews(submissions: DataFrame, events: DataFrame) -> DataFrame:
    """Submissions after their review events, taken in time order.

    A correction sets the fields it gives, makes a given date unambiguous and,
    once group and date are both known, completes the submission. Validation
    makes it a completed success, rejection a failure; a status may only be set
    to one of the four settable ones. Each field is the last value some event
    gave it, so every field is one aggregate and no event list is gathered.
    """
    rows = _prepared(events)
    # When group and date first became known to a correction.
    known = rows.groupBy("evidence_id").agg(
        F.min(F.when(F.col("new_group").isNotNull(), F.struct(*ORDER))).alias("group_at"),
        F.min(F.when(F.col("new_date").isNotNull(), F.struct(*ORDER))).alias("date_at"),
    )
    base = submissions.select(
        "evidence_id", present(F.col("group_id")).alias("has_group"), present(F.col("sync_date")).alias("has_date")
    )
    rows = split_join(rows, base.join(known, "evidence_id"), ["evidence_id"], "inner")
    here = F.struct(*ORDER)
    complete = (
        (F.col("kind") == "correct")
        & (F.col("has_group") | F.coalesce(F.col("group_at") <= here, F.lit(False)))
        & (F.col("has_date") | F.coalesce(F.col("date_at") <= here, F.lit(False)))
    )
    outcome = (
        F.when(F.col("kind") == "validate", "COMPLETED").when(F.col("kind") == "reject", "FAILED")
        .when(F.col("new_status").isin(*K.SETTABLE), F.col("new_status")).when(complete, "COMPLETED")
    )
    rows = rows.withColumns({"outcome": outcome, "complete": complete})

    def last(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), here)).alias(f"r_{column}")

    folded = rows.groupBy("evidence_id").agg(
        last("new_group"), last("new_date"), last("new_application"), last("outcome"),
        F.bool_or(F.col("kind") == "validate").alias("validated"),
        F.bool_or("complete").alias("completed"),
    )
    joined = submissions.join(folded, "evidence_id", "left")
    validated = F.coalesce("validated", F.lit(False))
    settled = validated | F.coalesce("completed", F.lit(False))
    return joined.withColumns({
        "group_id": F.coalesce("r_new_group", "group_id"),
        "sync_date": F.coalesce("r_new_date", "sync_date"),
        "application_id": F.coalesce("r_new_application", "application_id"),
        "date_is_ambiguous": F.when(F.col("r_new_date").isNotNull(), False).otherwise(F.col("date_is_ambiguous")),
        "requires_review": F.when(settled, False).otherwise(F.col("requires_review")),
        "sync_status": F.when(validated, "SUCCESS").otherwise(F.col("sync_status")),
        "processing_status": F.coalesce("r_outcome", "processing_status"),
    }).select(*submissions.columns)


def review_history(events: DataFrame) -> DataFrame:
    """The correction history as rows: one per correction or validation, ordered by `at_time`."""
    rows = _prepared(events).where(F.col("kind").isin("correct", "validate"))
    validated = F.col("kind") == "validate"
    return rows.select(
        "evidence_id", "at_time", "kind", "new_group", "new_date",
        F.when(validated, "SUCCESS").alias("new_sync_status"),
        F.when(validated, K.TEXT_VALIDATED).alias("evidence_text"),
    )
