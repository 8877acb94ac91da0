"""Counts, shares and time series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import predicates as P
from proofline.functions.joins import side_by_side, split_join
from proofline.functions.text import month_key, week_start

DEFAULT_WINDOW = {"day": 30, "week": 91, "month": 365}


def _now(now: dt.datetime | dt.date | str) -> Column:
    text = now if isinstance(now, str) else now.isoformat()
    return F.lit(text.replace("T", " ")).cast("timestamp_ntz")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1)).otherwise(0.0)


def status_share(results: DataFrame) -> DataFrame:
    """status, n and percent of all results (one decimal)."""
    counts = results.groupBy("status").agg(F.count("*").alias("n"))
    # The window spans the counts, at most one row per status.
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("status", "n", F.round(F.col("n") * 100.0 / total, 1).alias("percent"))


def _results_in_period(
    results: DataFrame, submissions: DataFrame, start: dt.date | str | None, end: dt.date | str | None
) -> DataFrame:
    """With a period only results tied to a submission received in it count."""
    if start is None and end is None:
        return results
    inside = submissions.where(P.period_filter(F.col("received_at"), start, end)).select("evidence_id")
    return results.join(inside, "evidence_id", "left_semi")


def overview(
    submissions: DataFrame, results: DataFrame,
    start: dt.date | str | None = None, end: dt.date | str | None = None,
) -> DataFrame:
    """All headline figures as one row: one pass over submissions, one over results."""
    rows = P.report_category(submissions.where(P.period_filter(F.col("received_at"), start, end)))

    def status(*names: str) -> Column:
        return F.count_if(F.coalesce(F.col("processing_status").isin(*names), F.lit(False)))

    proofs = rows.agg(
        F.count("*").alias("total_evidence"),
        F.count_if(F.col("media_type") == "image").alias("total_images"),
        F.count_if(F.col("media_type") == "video").alias("total_videos"),
        status("COMPLETED").alias("processed"),
        status(*K.TRANSITIONAL).alias("pending"),
        status("REQUIRES_REVIEW").alias("requires_review"),
        status("FAILED").alias("failed"),
        F.count_if(P.readable_filter()).alias("readable"),
        F.count_if(F.col("sync_visible")).alias("cat_sync_visible"),
        F.count_if(F.col("sync_review")).alias("cat_sync_review"),
        *[F.count_if(F.col("category") == c).alias(f"cat_{c.lower()}")
          for c in ("VALID", "PENDING", "DUPLICATE", "NOT_VALIDATED")],
    )
    outcome = F.col("status")
    runs = _results_in_period(results, submissions, start, end).agg(
        F.count("*").alias("reconciled"),
        F.count_if(outcome == "CONFORME").alias("conform"),
        F.count_if(outcome == "ECART_DATE").alias("date_gaps"),
        F.count_if(outcome == "ECHEC_SYNCHRONISATION").alias("sync_failures"),
        F.count_if(outcome.isin("ID_ILLISIBLE", "DATE_ILLISIBLE")).alias("unreadable"),
    )
    return side_by_side(proofs, runs).select(
        "*", _percent(F.col("conform"), F.col("reconciled")).alias("conformity_rate"),
        _percent(F.col("processed"), F.col("total_evidence")).alias("automatic_rate"),
    ).drop("reconciled")


def by_application(
    applications: DataFrame, submissions: DataFrame, results: DataFrame,
    start: dt.date | str | None = None, end: dt.date | str | None = None,
) -> DataFrame:
    """Received, conform and date gaps of every application, zero rows included."""
    inside = submissions.where(P.period_filter(F.col("received_at"), start, end))
    received = inside.groupBy("application_id").agg(F.count("*").alias("total_evidence"))
    tied = results.where("evidence_id IS NOT NULL")
    outcomes = _results_in_period(tied, submissions, start, end).groupBy("application_id").agg(
        F.count_if(F.col("status") == "CONFORME").alias("conform"),
        F.count_if(F.col("status") == "ECART_DATE").alias("date_gaps"),
    )
    figures = ("total_evidence", "conform", "date_gaps")
    return (
        applications.select("application_id", F.col("name").alias("application"))
        .join(received, "application_id", "left").join(outcomes, "application_id", "left")
        .select("application_id", "application", *[F.coalesce(c, F.lit(0)).alias(c) for c in figures])
    )


def by_period(
    submissions: DataFrame, granularity: str, now: dt.datetime | str, days: int | None = None
) -> DataFrame:
    """Submissions per day, Monday week or month over the last `days`."""
    window = DEFAULT_WINDOW[granularity] if days is None else days
    since = _now(now) - F.expr(f"INTERVAL {int(window)} DAYS")
    received = F.col("received_at")
    label = {
        "day": F.to_date(received).cast("string"), "week": week_start(received), "month": month_key(received)
    }[granularity]
    return submissions.where(received >= since).groupBy(label.alias("period")).agg(F.count("*").alias("n"))


def anomalies(
    results: DataFrame, submissions: DataFrame,
    start: dt.date | str | None = None, end: dt.date | str | None = None,
) -> DataFrame:
    """Counts of the statuses other than conform that occur, with their fixed rank."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(K.ANOMALY_ORDER) for x in (s, i)])
    rows = _results_in_period(results, submissions, start, end).where(F.col("status").isin(*K.ANOMALY_ORDER))
    return rows.groupBy("status").agg(F.count("*").alias("n")).select("status", "n", rank[F.col("status")].alias("rank"))


def operational_totals(rows: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Long-form totals (measure, value) of one dataset; counts per status are `status:<name>`.

    Distinct people are counted over a table already reduced to one row per person.
    """
    columns = set(rows.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("string")

    agent, sender = col("agent_id").cast("string"), col("sender_identity")
    per_status = rows.groupBy(F.concat(F.lit("status:"), F.col("status")).alias("measure")).agg(
        F.count("*").alias("value")
    )
    people = rows.select(agent.alias("a"), F.when(agent.isNull(), sender).alias("s")).distinct()
    distinct = people.agg(
        F.count("a").alias("registered_agents"), F.count("s").alias("unregistered_contacts"),
    )
    single = rows.agg(
        F.count("*").alias("total"),
        F.count_if(agent.isNull() & sender.isNull()).alias("unknown_sender_reports"),
        F.count_if(F.coalesce(col("processing_status") == "REQUIRES_REVIEW", F.lit(False))).alias("review_queue"),
    )
    base = rows if evidence is None else evidence
    loose = base.agg(
        F.count_if(F.col("agent_id").isNull() | (F.col("date_basis") != "report_date")).alias("unattributed")
    )
    tall = [per_status] + [
        part.unpivot([], part.columns, "measure", "value") for part in (distinct, single, loose)
    ]
    return reduce(DataFrame.unionByName, tall)


def channel_stats(channels: DataFrame, messages: DataFrame, today: dt.date | str) -> DataFrame:
    """Per channel: media downloaded today and failures, in one pass over messages."""
    fetched = (F.col("download_status") == "DOWNLOADED") & (F.col("message_date") >= _now(str(today)))
    counts = messages.groupBy("channel_id").agg(
        F.count_if(fetched).alias("media_today"),
        F.count_if(F.col("download_status") == "FAILED").alias("errors"),
    )
    return channels.select("channel_id", "name", "is_monitored").join(counts, "channel_id", "left").select(
        "channel_id", "name", "is_monitored",
        F.coalesce("media_today", F.lit(0)).alias("media_today"), F.coalesce("errors", F.lit(0)).alias("errors"),
    )


def queue_summary(messages: DataFrame, submissions: DataFrame) -> DataFrame:
    """One row: messages by download state, and those whose submission is in processing."""
    def state(name: str) -> Column:
        return F.count_if(F.col("download_status") == name)

    states = messages.agg(
        state("PENDING").alias("pending"), state("DOWNLOADING").alias("downloading"),
        state("FAILED").alias("failed"), state("SKIPPED_UNAUTHORIZED_GROUP").alias("unassigned"),
    )
    busy = submissions.where(F.col("processing_status").isin("QUEUED", "PROCESSING")).select("evidence_id")
    working = messages.join(busy, "evidence_id", "left_semi").agg(F.count("*").alias("processing"))
    return side_by_side(states, working)


def frequent_recipients(attempts: DataFrame, today: dt.date | str, min_sends: int = 6) -> DataFrame:
    """Recipients with at least `min_sends` distinct confirmed sends in the month of `today`."""
    sent = attempts.where(
        F.col("status").isin(*K.CONFIRMED_SENDS) & (month_key(F.col("created_at")) == str(today)[:7])
    )
    key = F.coalesce(
        F.nullif(F.col("external_message_id"), F.lit("")),
        F.when(
            F.col("status") == "MANUALLY_CONFIRMED",
            F.concat_ws("\u0001", F.to_date("created_at").cast("string"), F.col("body")),
        ),
        F.concat(F.lit("attempt "), F.col("attempt_id").cast("string")),
    )
    distinct = sent.select("recipient", key.alias("send")).distinct()
    return distinct.groupBy("recipient").agg(F.count("*").alias("sent_count")).where(
        F.col("sent_count") >= min_sends
    )


def campaign_stats(campaigns: DataFrame, today: dt.date | str) -> DataFrame:
    """Campaigns of today by status."""
    return campaigns.where(F.col("day") == str(today)).groupBy("status").agg(F.count("*").alias("n"))


def campaign_recipients(campaigns: DataFrame, limit: int = 200) -> DataFrame:
    """The newest campaigns of all days, of one day by recipient: a page of `limit` rows in order."""
    return campaigns.select("day", "recipient", "status").orderBy(F.col("day").desc(), "recipient", "status").limit(limit)


def campaign_runs(runs: DataFrame, limit: int = 30) -> DataFrame:
    """The last runs of the campaign job with their results, newest first."""
    return runs.select("run_id", "created_at", "result").orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)


def job_health(jobs: DataFrame) -> DataFrame:
    """One row: open and failed jobs."""
    return jobs.agg(
        F.count_if(F.col("status").isin(*K.TRANSITIONAL)).alias("open_jobs"),
        F.count_if(F.col("status") == "FAILED").alias("failed_jobs"),
    )


def registry_totals(**tables: DataFrame) -> DataFrame:
    """Total and active rows of each registry."""
    counts = [
        df.agg(
            F.lit(name).alias("registry"), F.count("*").alias("total"),
            F.count_if(F.col("is_active")).alias("active"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def confidence_rollup(readings: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Per proof: mean and best reading confidence, and the global score over the given parts.

    The global score is the mean of the part confidences and the mean reading
    confidence; after a status refresh the best reading is used instead.
    """
    rolled = readings.groupBy("proof_id").agg(
        F.avg("confidence").alias("mean_ocr"), F.max("confidence").alias("best_ocr"),
        *[F.max(p).alias(p) for p in parts],
    )
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts], F.lit(0.0))
    n = len(parts) + 1
    return rolled.select(
        "proof_id", F.round("mean_ocr", 3).alias("mean_ocr"), "best_ocr",
        F.round((total + F.col("mean_ocr")) / n, 3).alias("global_confidence"),
        F.round((total + F.col("best_ocr")) / n, 3).alias("refreshed_confidence"),
    )


def keyword_union(profiles: DataFrame, defaults: Sequence[str]) -> DataFrame:
    """Distinct keywords of all active profiles, with the defaults. One row per keyword."""
    own = profiles.where("is_active").select(F.explode("keywords").alias("keyword"))
    fixed = profiles.sparkSession.createDataFrame([(k,) for k in defaults], "keyword string")
    return own.unionByName(fixed).distinct()


def agents_nested(agents: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each agent with its assignments, a row for each (application, group); nulls where an agent has none.

    Rows and not lists: the shape does not change with the number of assignments.
    """
    own = assignments.select("agent_id", "application_id", "group_id").distinct()
    return agents.select("agent_id", "full_name").join(own, "agent_id", "left")
