"""Claims against the official ledger: one status per claim, one per unclaimed row.

Nothing here compares a claim with each row of its group. Claims and ledger
rows are first reduced to distinct (group, application, date) points; the
nearest ledger date on each side is then read off one ordered pass per group,
whose length is bounded by the calendar and not by the number of rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import predicates as P
from proofline.functions.joins import first_by, lookup, split_join
from proofline.functions.text import present

ANY_APPLICATION = "\u0001any"
NO_GAP = 2**31 - 1
CLAIM_KEY = ["application_id", "group_id", "sync_date"]


def claims_in_scope(
    submissions: DataFrame, app: str | None = None,
    start: dt.date | str | None = None, end: dt.date | str | None = None,
) -> DataFrame:
    """Finished originals of the application and period."""
    rows = submissions.where(
        F.col("processing_status").isin(*K.FINISHED) & F.col("duplicate_of_id").isNull()
    ).where(P.claim_period_filter(F.col("sync_date"), F.col("received_at"), start, end))
    return rows if app is None else rows.where(F.col("application_id") == app)


def ledger_in_scope(
    ledger: DataFrame, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> DataFrame:
    """Valid rows whose date text lies in the period; a missing date only passes when no bound is set."""
    rows = ledger.where("is_valid")
    if start is not None:
        rows = rows.where(F.col("sync_date") >= str(start))
    if end is not None:
        rows = rows.where(F.col("sync_date") <= str(end))
    return rows


def ledger_anti(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """Ledger rows whose group no claim mentions, whatever the claim's date or status."""
    claimed = claims.where(present(F.col("group_id"))).select("group_id").distinct()
    return split_join(ledger.where(present(F.col("group_id"))), claimed, ["group_id"], "left_anti")


def _flag(claims: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    marked = groups.where(F.col("group_id").isNotNull()).select("group_id").distinct().withColumn(name, F.lit(True))
    spread = "evidence_id" if "evidence_id" in claims.columns else "sync_date"
    return lookup(claims, marked, "group_id", spread).withColumn(name, F.coalesce(name, F.lit(False)))


def wrong_application(claims: DataFrame, ledger_all: DataFrame, app: str | None) -> DataFrame:
    """Adds in_other_application: the group is in a ledger of another application.

    Every import counts, valid or not. Without an application there is no other one.
    """
    if app is None:
        return claims.withColumn("in_other_application", F.lit(False))
    others = ledger_all.where(F.col("application_id") != app)
    return _flag(claims, others, "in_other_application")


def unknown_group(claims: DataFrame, assignments: DataFrame, app: str | None) -> DataFrame:
    """Adds is_unknown: assignments exist for the application and none is for this group."""
    if app is None:
        return claims.withColumn("is_unknown", F.lit(False))
    own = assignments.where(F.col("application_id") == app)
    # A scalar subquery: computed once, joined with nothing.
    any_assignment = own.select((F.count("*") > 0).alias("x")).scalar()
    flagged = _flag(claims, own, "is_assigned")
    return flagged.withColumn("is_unknown", any_assignment & ~F.col("is_assigned")).drop("is_assigned")


def _ledger_points(ledger: DataFrame) -> DataFrame:
    """First row of each (group, application, date); a ledger of no application serves all of them."""
    return (
        ledger.where(present(F.col("group_id")))
        .select(
            "group_id", F.coalesce("application_id", F.lit(ANY_APPLICATION)).alias("scope"),
            "sync_date", F.expr("try_cast(sync_date AS date)").alias("d"), "row_id",
        )
        .groupBy("group_id", "scope", "sync_date", "d").agg(F.min("row_id").alias("row_id"))
    )


def _nearest_points(points: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds the best ledger row to each distinct (application, group, date) of claims.

    Other columns of `points` are kept; row_id is null where the group has no row.
    """
    marks = _ledger_points(ledger).groupBy("group_id", "scope", "d").agg(
        F.min(F.struct("row_id", "sync_date")).alias("mark")
    )
    kept = [c for c in points.columns if c not in CLAIM_KEY]
    probes = points.select(
        "group_id", F.explode(F.array(F.col("application_id"), F.lit(ANY_APPLICATION))).alias("scope"),
        F.struct(*CLAIM_KEY, *kept).alias("point"), F.expr("try_cast(sync_date AS date)").alias("d"),
    )
    line = probes.unionByName(marks, allowMissingColumns=True)
    # Both passes look backwards, so each is linear in the dates of a group.
    scope = Window.partitionBy("group_id", "scope")
    whole_day = (Window.unboundedPreceding, Window.currentRow)
    at = F.when(F.col("mark").isNotNull() & F.col("d").isNotNull(), F.struct("d", "mark"))
    line = line.withColumns({
        "before": F.last(at, ignorenulls=True).over(scope.orderBy(F.col("d")).rangeBetween(*whole_day)),
        "after": F.last(at, ignorenulls=True).over(scope.orderBy(F.col("d").desc()).rangeBetween(*whole_day)),
        # Any row of the group, for when no date can be compared.
        "fallback": F.min("mark").over(scope),
    }).where("point IS NOT NULL")

    def option(side: str) -> Column:
        hit = F.col(side)
        return F.when(
            hit.isNotNull() & F.col("d").isNotNull(),
            F.struct(
                F.abs(F.datediff(F.col("d"), hit["d"])).alias("gap"),
                hit["mark"]["row_id"].alias("row_id"), hit["mark"]["sync_date"].alias("ledger_date"),
            ),
        )

    no_gap = F.when(F.col("fallback").isNotNull(), F.struct(
        F.lit(NO_GAP).alias("gap"), F.col("fallback.row_id").alias("row_id"),
        F.col("fallback.sync_date").alias("ledger_date"),
    ))
    best = F.least(option("before"), option("after"), no_gap)
    return line.groupBy("point").agg(F.min(best).alias("best")).select(
        "point.*", "best.row_id", "best.ledger_date",
        F.nullif(F.col("best.gap"), F.lit(NO_GAP)).alias("gap"),
    )


def nearest_date_match(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """(evidence_id, row_id, ledger_date, gap): the ledger row of the group nearest in days.

    Rows of the claim's application, or of none, qualify. Ties go to the lowest
    row id; a row whose date cannot be read is the last resort, with a null gap.
    """
    known = claims.where(present(F.col("group_id")) & F.col("application_id").isNotNull())
    best = _nearest_points(known.select(*CLAIM_KEY).distinct(), ledger).where("row_id IS NOT NULL")
    return split_join(known.select("evidence_id", *CLAIM_KEY), best, CLAIM_KEY, "inner").select(
        "evidence_id", "row_id", "ledger_date", "gap"
    )


def gate() -> Column:
    """What stops a claim before it is compared with anything, or null: a status that its own columns settle."""
    needs_check = (
        F.coalesce("requires_review", F.lit(True)) | F.coalesce("date_is_ambiguous", F.lit(True))
        | ~present(F.col("application_id").cast("string")) | (F.col("processing_status") != "COMPLETED")
    )
    return (
        F.when(~present(F.col("group_id")), "ID_ILLISIBLE")
        .when(~present(F.col("sync_date")), "DATE_ILLISIBLE")
        .when(F.col("sync_status") == "FAILED", "ECHEC_SYNCHRONISATION")
        .when(F.coalesce(F.col("sync_status") != "SUCCESS", F.lit(True)), "SYNCHRONISATION_NON_CONFIRMEE")
        .when(needs_check, "VERIFICATION_MANUELLE")
    )


def dup_claims(claims: DataFrame) -> DataFrame:
    """Adds is_repeat: an earlier claim that passes the gates has the same application, group and date.

    A claim that a gate stops is neither a repeat nor repeated.
    """
    rows = claims.withColumn("__gate", gate())
    first = first_by(rows.where("__gate IS NULL"), CLAIM_KEY, ["received_at", "evidence_id"], ["evidence_id"])
    joined = split_join(rows, first.withColumnRenamed("evidence_id", "first_id"), CLAIM_KEY)
    again = F.col("__gate").isNull() & (F.col("evidence_id") != F.col("first_id"))
    return joined.withColumn("is_repeat", F.coalesce(again, F.lit(False))).drop("first_id", "__gate")


def dup_ledger(ledger: DataFrame) -> DataFrame:
    """Adds n: how many rows share the group and date (all copies carry it)."""
    counts = ledger.groupBy("group_id", "sync_date").agg(F.count("*").alias("n"))
    return split_join(ledger, counts, ["group_id", "sync_date"])


def result_union(claim_side: DataFrame, ledger_side: DataFrame) -> DataFrame:
    """All results; columns one side lacks are null."""
    return claim_side.unionByName(ledger_side, allowMissingColumns=True)


def _claim_results(
    claims: DataFrame, ledger: DataFrame, ledger_all: DataFrame, assignments: DataFrame,
    app: str | None, tolerance_days: int,
) -> DataFrame:
    gated = claims.withColumn("gate", gate())
    # Everything below depends on the distinct (application, group, date) only.
    open_claims = gated.where("gate IS NULL")
    points = open_claims.groupBy(*CLAIM_KEY).agg(
        F.min_by("evidence_id", F.struct("received_at", "evidence_id")).alias("first_id")
    )
    points = _nearest_points(points, ledger)
    points = unknown_group(wrong_application(points, ledger_all, app), assignments, app)
    points = points.withColumn(
        "point_status",
        F.when(F.col("row_id").isNull() & F.col("in_other_application"), "MAUVAISE_APPLICATION")
        .when(F.col("row_id").isNull() & F.col("is_unknown"), "ID_INCONNU")
        .when(F.col("row_id").isNull(), "DECLARE_WHATSAPP_ABSENT_DASHBOARD")
        .when((F.col("sync_date") == F.col("ledger_date")) | (F.col("gap") <= tolerance_days), "CONFORME")
        .otherwise("ECART_DATE"),
    )
    # Claims stopped at a gate never meet the shuffle of the open ones.
    stopped = gated.where("gate IS NOT NULL").select(
        "evidence_id", "application_id", F.col("gate").alias("status"),
        F.col("group_id").alias("whatsapp_group_id"), F.col("sync_date").alias("whatsapp_date"), "confidence",
    )
    verdicts = points.select(*CLAIM_KEY, "first_id", "row_id", "ledger_date", "point_status")
    joined = split_join(open_claims, verdicts, CLAIM_KEY, "inner")
    status = (
        F.when(F.col("point_status") == "MAUVAISE_APPLICATION", F.col("point_status"))
        .when(F.col("evidence_id") != F.col("first_id"), "DOUBLON_WHATSAPP")
        .otherwise(F.col("point_status"))
    )
    matched = status.isin("CONFORME", "ECART_DATE")
    classified = joined.select(
        "evidence_id", "application_id", status.alias("status"),
        F.col("group_id").alias("whatsapp_group_id"), F.col("sync_date").alias("whatsapp_date"), "confidence",
        F.when(matched, F.col("group_id")).alias("dashboard_group_id"),
        F.when(matched, F.col("ledger_date")).alias("dashboard_date"),
        F.when(matched, F.col("row_id")).alias("row_id"),
    )
    return classified.unionByName(stopped, allowMissingColumns=True)


def _ledger_results(ledger: DataFrame, claims: DataFrame, app: str | None) -> DataFrame:
    # A group is claimed or not as a whole, so rows are counted first and the
    # counts filtered; the rows themselves move once.
    open_days = ledger_anti(ledger.groupBy("group_id", "sync_date").agg(F.count("*").alias("n")), claims)
    open_rows = split_join(ledger, open_days, ["group_id", "sync_date"], "inner")
    locality = F.col("locality") if "locality" in ledger.columns else F.lit(None).cast("string")
    return open_rows.select(
        F.lit(app).cast("string").alias("application_id"),
        F.when(F.col("n") > 1, "DOUBLON_DASHBOARD").otherwise("DASHBOARD_SANS_PREUVE_WHATSAPP").alias("status"),
        F.col("group_id").alias("dashboard_group_id"), F.col("sync_date").alias("dashboard_date"),
        "row_id", locality.alias("locality"),
    )


def reconcile(
    submissions: DataFrame, ledger: DataFrame, ledger_all: DataFrame, assignments: DataFrame,
    app: str | None = None, start: dt.date | str | None = None, end: dt.date | str | None = None,
    tolerance_days: int = 0,
) -> DataFrame:
    """Results of one run: exactly one row per claim in scope and per unclaimed ledger row.

    `ledger` is the import to compare with; `ledger_all` holds every import, to
    tell a group reported under the wrong application.
    """
    claims = claims_in_scope(submissions, app, start, end)
    rows = ledger_in_scope(ledger, start, end)
    return result_union(
        _claim_results(claims, rows, ledger_all, assignments, app, tolerance_days),
        _ledger_results(rows, claims, app),
    )


def run_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))
