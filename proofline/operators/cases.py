"""Follow-up cases: opened by an unusable proof, closed by the first later usable one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import predicates as P
from proofline.functions.joins import lookup
from proofline.functions.text import present, recipient
from proofline.operators.identity import KEY, has_report_key, report_key
from proofline.operators.timeline import asof_forward_match


def _now(now: dt.datetime | str):
    text = now.isoformat(sep=" ") if isinstance(now, dt.datetime) else now
    return F.lit(text).cast("timestamp_ntz")


def _pair_sides(pairs: DataFrame, submissions: DataFrame) -> DataFrame:
    """Given (evidence_id, replacement_id) pairs with both submissions beside them, as a and b."""
    sides = submissions.withColumns({"usable": P.usable_filter(), "complete": has_report_key()})
    asked = pairs.select("evidence_id", "replacement_id").alias("p")
    return asked.join(
        sides.alias("a"), F.col("p.evidence_id") == F.col("a.evidence_id"), "left"
    ).join(sides.alias("b"), F.col("p.replacement_id") == F.col("b.evidence_id"), "left")


def _verdict(rows: DataFrame, condition: Column) -> DataFrame:
    fine = (
        F.col("b.usable") & (F.col("a.sender_identity") == F.col("b.sender_identity"))
        & (F.col("b.received_at") >= F.col("a.received_at")) & condition
    )
    return rows.select("p.evidence_id", "p.replacement_id", F.coalesce(fine, F.lit(False)).alias("ok"))


def match_guards(pairs: DataFrame, submissions: DataFrame) -> DataFrame:
    """Adds ok: the pair may be matched without an operator.

    Usable, same sender, not older, and the whole report key known and equal on
    both sides. It judges given pairs; `asof_forward_match` finds the winner of
    each original without forming any.
    """
    condition = F.col("a.complete") & F.col("b.complete")
    for name in KEY[1:]:
        condition = condition & (F.col(f"a.{name}") == F.col(f"b.{name}"))
    return _verdict(_pair_sides(pairs, submissions), condition)


def manual_link_check(pairs: DataFrame, submissions: DataFrame) -> DataFrame:
    """Adds ok: the replacement an operator chose is usable, of the same sender, not older,
    and contradicts nothing known about the original."""
    fits = F.lit(True)
    for name in KEY[1:]:
        known = present(F.col(f"a.{name}").cast("string"))
        fits = fits & (~known | F.coalesce(F.col(f"a.{name}") == F.col(f"b.{name}"), F.lit(False)))
    return _verdict(_pair_sides(pairs, submissions), fits)


def rebuild_cases(cases: DataFrame, submissions: DataFrame, now: dt.datetime | str) -> DataFrame:
    """All cases recomputed from the prior ones and the submissions; running it twice changes nothing.

    A resolved case reopens when its replacement stopped being usable (unless it
    is being processed again). Every problem has a case. An unresolved case
    closes by itself when its proof became usable, else with the as-of match.
    `submissions` carries sender_identity.
    """
    rows = submissions.withColumns({
        "usable": P.usable_filter(), "transitional": P.is_transitional(), "new_reason": P.reason(),
    })
    keyed = rows.where(has_report_key())
    matches = asof_forward_match(
        keyed.where("new_reason IS NOT NULL OR NOT usable"), keyed.where("usable"), KEY
    ).withColumnRenamed("evidence_id", "match_for")

    prior = cases.select(
        "case_evidence_id", F.col("status").alias("old_status"),
        F.col("replacement_evidence_id").alias("old_replacement"), "created_at",
        (F.col("reason") if "reason" in cases.columns else F.lit(None).cast("string")).alias("old_reason"),
        (F.col("resolved_at") if "resolved_at" in cases.columns else F.lit(None).cast("timestamp_ntz"))
        .alias("old_resolved_at"),
    )
    replacements = rows.select(
        F.col("evidence_id").alias("old_replacement"), F.col("usable").alias("rep_usable"),
        F.col("transitional").alias("rep_transitional"),
    )
    prior = prior.where("old_replacement IS NOT NULL").join(replacements, "old_replacement", "left").unionByName(
        prior.where("old_replacement IS NULL"), allowMissingColumns=True
    )
    reopened = F.coalesce(
        (F.col("old_status") == "RESOLVED") & ~F.col("rep_usable") & ~F.col("rep_transitional"), F.lit(False)
    )
    merged = rows.join(prior, rows["evidence_id"] == prior["case_evidence_id"], "full").join(
        matches, F.col("evidence_id") == F.col("match_for"), "left"
    )
    settled = F.coalesce((F.col("old_status") == "RESOLVED") & ~reopened, F.lit(False))
    answer = F.when(F.col("usable"), F.col("evidence_id")).otherwise(F.col("replacement_id"))
    closes = ~settled & F.coalesce(answer.isNotNull() & F.col("evidence_id").isNotNull(), F.lit(False))
    return merged.where(F.col("case_evidence_id").isNotNull() | F.col("new_reason").isNotNull()).select(
        F.coalesce("case_evidence_id", "evidence_id").alias("case_evidence_id"),
        F.when(settled | closes, "RESOLVED").when(reopened | F.col("old_status").isNull(), "OPEN")
        .otherwise(F.col("old_status")).alias("status"),
        F.when(settled, F.col("old_replacement")).when(closes, answer).alias("replacement_evidence_id"),
        F.when(settled, F.col("old_reason")).otherwise(F.coalesce("new_reason", "old_reason")).alias("reason"),
        F.coalesce("created_at", _now(now)).alias("created_at"),
        F.when(settled, F.col("old_resolved_at")).when(closes, _now(now)).alias("resolved_at"),
    )


def complete_usable(submissions: DataFrame) -> DataFrame:
    """A usable submission waiting for review counts as completed once cases are rebuilt."""
    return submissions.withColumn(
        "processing_status",
        F.when(P.usable_filter(), "COMPLETED").otherwise(F.col("processing_status")),
    )


def rebuild_followups(cases: DataFrame, submissions: DataFrame, now: dt.datetime | str) -> tuple[DataFrame, DataFrame]:
    """(cases, submissions) after a rebuild: usable submissions that waited for review are completed, then cases are recomputed."""
    completed = complete_usable(submissions)
    return rebuild_cases(cases, completed, now), completed


def case_members(cases: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each case with its group: the report key when complete, else the case alone."""
    facts = submissions.select(
        F.col("evidence_id").alias("case_evidence_id"), "received_at", report_key().alias("report")
    )
    own = F.concat(F.lit("case "), F.col("case_evidence_id").cast("string"))
    return cases.join(facts, "case_evidence_id").withColumn("group_key", F.coalesce("report", own))


def case_groups(cases: DataFrame, submissions: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Cases of one report as one row, led by the earliest; members stay rows of `case_members`.

    With `attempts`, the row also sums up the reminders of all its cases. Attempts
    are reduced per case first, so cases are read and grouped once.
    """
    members = case_members(cases, submissions)
    order = F.struct("received_at", "case_evidence_id")
    done = F.col("status") == "RESOLVED"
    reason = F.col("reason") if "reason" in cases.columns else F.lit(None).cast("string")
    history = []
    if attempts is not None:
        confirmed = F.col("status").isin(*K.CONFIRMED_SENDS)
        per_case = attempts.groupBy("case_evidence_id").agg(
            F.count("*").alias("n"), F.min("created_at").alias("first_at"),
            F.max(F.struct("created_at", "attempt_id", "status")).alias("newest"),
            F.bool_or(F.col("status").isin(*K.UNCERTAIN_SENDS)).alias("uncertain"),
            F.count_if(confirmed).alias("sent"), F.max(F.when(confirmed, F.col("created_at"))).alias("sent_at"),
        )
        members = members.join(per_case, "case_evidence_id", "left")
        history = [
            F.coalesce(F.sum("n"), F.lit(0)).alias("attempt_count"), F.min("first_at").alias("first_attempt_at"),
            F.max("newest")["status"].alias("last_send_status"),
            F.coalesce(F.bool_or("uncertain"), F.lit(False)).alias("uncertain_send"),
            F.coalesce(F.sum("sent"), F.lit(0)).alias("sent_count"), F.max("sent_at").alias("last_sent_at"),
        ]
    return members.groupBy("group_key", "report").agg(
        F.min_by(F.struct("case_evidence_id", reason.alias("reason")), order).alias("lead"),
        F.min("received_at").alias("received_at"),
        F.count("*").alias("case_count"),
        F.coalesce(F.bool_or(done), F.lit(False)).alias("resolved"),
        F.min_by(F.struct("replacement_evidence_id"), F.when(done, order)).alias("winner"),
        *history,
    ).select("*", "lead.*", F.col("winner.replacement_evidence_id")).drop("lead", "winner")


def _with_returns(groups: DataFrame, submissions: DataFrame) -> DataFrame:
    """Adds returned_count to groups that carry their attempts.

    Each report has a single threshold, so rows are joined to one row per report
    and counted; pairs are never formed.
    """
    thresholds = groups.where("report IS NOT NULL AND first_attempt_at IS NOT NULL").select(
        "report", F.col("case_evidence_id").alias("lead"),
        F.greatest("received_at", "first_attempt_at").alias("after"),
    )
    later = submissions.where(F.col("duplicate_of_id").isNull()).select(
        "evidence_id", F.col("received_at").alias("came_at"), report_key().alias("report")
    ).where("report IS NOT NULL")
    counts = later.join(thresholds, "report").where("came_at > after AND evidence_id <> lead").groupBy(
        "report"
    ).agg(F.count("*").alias("returned_count"))
    return lookup(groups, counts, "report", "group_key").withColumn(
        "returned_count", F.coalesce("returned_count", F.lit(0))
    )


def returned_after_reminder(cases: DataFrame, submissions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per reminded case group: how many submissions of the same report, copies excluded, came
    after both the original and the first attempt."""
    groups = case_groups(cases, submissions, attempts).where("attempt_count > 0")
    return _with_returns(groups, submissions).select("group_key", "case_evidence_id", "returned_count")


def followup_rows(cases: DataFrame, submissions: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per case group with its derived status, history and return counts."""
    rows = _with_returns(case_groups(cases, submissions, attempts), submissions)
    return rows.select(
        "group_key", "case_evidence_id", "case_count", "reason",
        F.when(F.col("resolved"), "RESOLVED").when(F.col("returned_count") > 0, "RETURNED_INVALID")
        .when(F.col("attempt_count") > 0, "WAITING").otherwise("OPEN").alias("status"),
        "returned_count", "attempt_count", "last_send_status", "uncertain_send", "replacement_evidence_id",
        "sent_count", "last_sent_at",
    )


def days_since(sent_at: Column, now: dt.datetime | str) -> Column:
    """Whole days from an instant to now."""
    return F.floor(F.timestamp_diff("SECOND", sent_at, _now(now)) / 86400).cast("bigint")


def case_send_stats(
    cases: DataFrame, submissions: DataFrame, attempts: DataFrame, now: dt.datetime | str
) -> DataFrame:
    """Per case group: confirmed sends, the last one, and whole days since."""
    return case_groups(cases, submissions, attempts).select(
        "case_evidence_id", "sent_count", "last_sent_at",
        days_since(F.col("last_sent_at"), now).alias("days_since_reminder"),
    )


def case_history_join(
    attempts: DataFrame, cases: DataFrame, submissions: DataFrame, period: str, today: dt.date | str
) -> DataFrame:
    """Attempts of the current day, week or month with their case and submission."""
    day = dt.date.fromisoformat(today) if isinstance(today, str) else today
    start = {
        "day": day, "week": day - dt.timedelta(days=day.weekday()), "month": day.replace(day=1)
    }[period]
    recent = attempts.where(P.period_filter(F.col("created_at"), start, day))
    states = cases.select("case_evidence_id", F.col("status").alias("case_status"))
    proofs = submissions.select(F.col("evidence_id").alias("case_evidence_id"), "application_id", "sender_phone")
    return recent.join(states, "case_evidence_id").join(proofs, "case_evidence_id").select(
        "attempt_id", "case_evidence_id", "recipient", F.col("status").alias("send_status"),
        F.col("created_at").alias("sent_at"), "case_status", "application_id", "sender_phone",
    )


def with_recipient(submissions: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds recipient from the first sender, the sender's phone or else the phone of the registered agent."""
    phones = agents.select("agent_id", F.col("phone").alias("__agent_phone"))
    rows = lookup(submissions, phones, "agent_id", "evidence_id")
    return rows.withColumn(
        "recipient", recipient(F.col("sender_external_id"), F.col("sender_phone"), F.col("__agent_phone"))
    ).drop("__agent_phone")
