"""Reminder planning. Only planned rows are produced; nothing is sent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.joins import lookup, split_join
from proofline.functions.text import non_empty, suggested_message
from proofline.operators.cases import case_members, with_recipient

MIN_SECONDS = 60


def _now(now: dt.datetime | str) -> Column:
    text = now.isoformat(sep=" ") if isinstance(now, dt.datetime) else now
    return F.lit(text).cast("timestamp_ntz")


def _proofs(submissions: DataFrame, agents: DataFrame, applications: DataFrame) -> DataFrame:
    """Per submission whom to write to, and what to call its application."""
    names = applications.select("application_id", F.col("name").alias("application"))
    return lookup(with_recipient(submissions, agents), names, "application_id", "evidence_id").select(
        F.col("evidence_id").alias("case_evidence_id"), "recipient", "application", "group_id", "sync_date", "sender_name", "received_at",
    )


def _blocked_groups(members: DataFrame, attempts: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Case groups with an uncertain send or an attempt less than a minute old."""
    recent = F.timestamp_diff("SECOND", F.col("created_at"), _now(now)) < MIN_SECONDS
    return attempts.where(F.col("status").isin(*K.UNCERTAIN_SENDS) | recent).select("case_evidence_id").join(
        members.select("case_evidence_id", "group_key"), "case_evidence_id"
    ).select("group_key").distinct().withColumn("blocked", F.lit(True))


def reminder_candidates(
    ids: DataFrame, cases: DataFrame, submissions: DataFrame, attempts: DataFrame, agents: DataFrame, now: dt.datetime | str
) -> DataFrame:
    """One row per report among the requested cases, with what stands in the way.

    outcome: 'closed' (unknown or resolved), 'no_recipient', 'blocked' (a sibling
    case has an uncertain or very recent attempt), or 'ready'. Any outcome other
    than 'ready' fails the whole batch in the interactive flow.
    """
    asked = ids.select("case_evidence_id").distinct()
    members = case_members(cases, submissions)
    open_members = members.where(F.col("status") != "RESOLVED")
    blocked = _blocked_groups(open_members, attempts, now)
    rows = asked.join(
        open_members.select("case_evidence_id", "group_key"), "case_evidence_id", "left"
    ).join(
        with_recipient(submissions, agents).select(F.col("evidence_id").alias("case_evidence_id"), "recipient"), "case_evidence_id", "left"
    )
    rows = lookup(rows, blocked, "group_key", "case_evidence_id")
    lead = F.coalesce("group_key", F.concat(F.lit("unknown "), F.col("case_evidence_id").cast("string")))
    outcome = (
        F.when(F.col("group_key").isNull(), "closed").when(F.col("recipient").isNull(), "no_recipient")
        .when(F.col("blocked"), "blocked").otherwise("ready")
    )
    first = F.min_by(F.struct("case_evidence_id", "recipient", outcome.alias("outcome")), "case_evidence_id")
    return rows.withColumn("lead", lead).groupBy("lead").agg(first.alias("f")).select("f.*")


def prepare_drafts(
    cases: DataFrame, submissions: DataFrame, attempts: DataFrame, agents: DataFrame, applications: DataFrame,
    now: dt.datetime | str, n: int | None = None,
) -> DataFrame:
    """Every report that can be reminded, with its draft text; with `n`, the first ones, oldest case first."""
    members = case_members(cases, submissions)
    groups = members.groupBy("group_key").agg(
        F.min_by(F.struct("case_evidence_id", "reason"), F.struct("received_at", "case_evidence_id")).alias("lead"),
        F.bool_or(F.col("status") == "RESOLVED").alias("resolved"),
        F.min("received_at").alias("received_at"),
    ).where(~F.col("resolved"))
    ready = groups.join(_blocked_groups(members, attempts, now), "group_key", "left_anti").select(
        "lead.*", "received_at"
    )
    proofs = _proofs(submissions, agents, applications).drop("received_at")
    rows = ready.join(proofs, "case_evidence_id").where("recipient IS NOT NULL")
    body = suggested_message(
        F.col("sender_name"), F.col("application"), F.col("group_id"), F.col("sync_date"),
        F.col("reason"), F.col("case_evidence_id"),
    )
    if n is not None:
        rows = rows.orderBy("received_at", "case_evidence_id").limit(n)
    return rows.select("case_evidence_id", "recipient", body.alias("body"))


def digest_entries(
    cases: DataFrame, submissions: DataFrame, agents: DataFrame, applications: DataFrame, day: dt.date | str
) -> DataFrame:
    """Unresolved cases of proofs received on `day`, with the recipient and the line of the digest."""
    received = submissions.where(F.to_date("received_at") == F.lit(str(day)).cast("date"))
    facts = _proofs(received, agents, applications).select(
        "case_evidence_id", "recipient", "application", "group_id"
    ).where("recipient IS NOT NULL")
    text = F.concat(
        F.coalesce(non_empty(F.col("application")), F.lit(K.UNKNOWN_APPLICATION)), F.lit(" / "),
        F.coalesce(non_empty(F.col("group_id")), F.lit(K.UNREADABLE_GROUP)), F.lit(" : "), F.col("reason"),
        F.lit(". Réf. "), F.col("case_evidence_id").cast("string"),
    )
    return cases.where(F.col("status") != "RESOLVED").select("case_evidence_id", "reason").join(
        facts, "case_evidence_id"
    ).select("recipient", "case_evidence_id", text.alias("line"))


def reminder_digest(
    cases: DataFrame, submissions: DataFrame, attempts: DataFrame, campaigns: DataFrame, agents: DataFrame,
    applications: DataFrame, day: dt.date | str, max_chars: int = K.DIGEST_MAX_CHARS,
) -> DataFrame:
    """One row per recipient of the day: prepared with a body, or skipped with the reason.

    Skipped when a campaign exists, when any attempt ever stayed uncertain, when
    one was confirmed that day, or when the body would be too long. The length
    follows from counts and sums, so lines are gathered only where they fit.
    """
    lines = digest_entries(cases, submissions, agents, applications, day)
    opening = K.DIGEST_OPENING.format(day)
    closing = "\n".join((K.DIGEST_CLOSING, K.RECORDING_INSTRUCTIONS, K.PRIVATE_CHAT_NOTICE))
    sizes = lines.groupBy("recipient").agg(
        F.count("*").alias("entries"), F.sum(F.length("line")).alias("letters")
    )
    n = F.col("entries")
    # Digits of the numbers 1..n: every power of ten adds a digit to the numbers from it on.
    digits = F.lit(0).cast("bigint")
    for power in range(0, 10):
        digits = digits + F.greatest(n - F.lit(10**power - 1), F.lit(0))
    # Each numbered line adds ". " and a line break.
    length = F.lit(len(opening) + len(closing) + 1) + F.col("letters") + digits + n * 3
    stopped = campaigns.where(F.col("day") == str(day)).select("recipient").unionByName(
        attempts.where(
            F.col("status").isin(*K.UNCERTAIN_SENDS)
            | (F.col("status").isin(*K.CONFIRMED_SENDS)
               & (F.to_date("created_at") == F.lit(str(day)).cast("date")))
        ).select("recipient")
    ).distinct().withColumn("stopped", F.lit(True))
    plan = sizes.join(stopped, "recipient", "left").select(
        "recipient", "entries", length.alias("body_length"),
        F.when(F.col("stopped"), "skipped_sent_or_uncertain")
        .when(length > max_chars, "skipped_too_long").otherwise("prepared").alias("outcome"),
    )
    prepared = plan.where("outcome = 'prepared'").select("recipient")
    fits = split_join(lines, prepared, ["recipient"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("case_evidence_id", "line")))
    numbered = F.transform(ordered, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["line"]))
    bodies = fits.groupBy("recipient").agg(
        F.concat_ws("\n", F.lit(opening), F.array_join(numbered, "\n"), F.lit(closing)).alias("body")
    )
    return plan.join(bodies, "recipient", "left")


def daily_digest(
    cases: DataFrame, submissions: DataFrame, attempts: DataFrame, campaigns: DataFrame, agents: DataFrame,
    applications: DataFrame, now: dt.datetime,
) -> DataFrame:
    """The digest of the day of `now`; empty before the evening hour."""
    digest = reminder_digest(cases, submissions, attempts, campaigns, agents, applications, now.date().isoformat())
    return digest if now.hour >= K.DIGEST_HOUR else digest.where(F.lit(False))

