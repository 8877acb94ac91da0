"""One registered query per operator, each over whole test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import dates, ids, similarity, status, text
from proofline.functions import predicates as P
from proofline.operators import (
    cases, coverage, frames, grid, identity, imports, listing, matching, reconcile, reminders, reports,
    reviews, stats, timeline, windows,
)
from proofline.plans import datasets
from proofline.plans.fixtures import Tables
from proofline.session import scratch
from proofline.sources import readers, sinks
from proofline.streaming import feed

NOW = "2024-01-30 22:30:00"
TODAY = "2024-01-30"
START, END = dt.date(2024, 1, 8), dt.date(2024, 1, 21)
APP = "app0"
CUTOFF = "2024-01-03 00:00:00"
RAW_MAPPING = {"group_id": "raw_id", "sync_date": "raw_date", "agent": "agent", "locality": "locality"}
REGISTRY = [
    ("a1", "fieldcoach", "FieldCoach", ["field coach"]), ("a2", "synchro", "Synchronisation", ["synchroniser"]),
    ("a3", "completion", "Completed", []),
]
Query = Callable[[Tables], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def _results(t: Tables, app: str | None = APP) -> DataFrame:
    ledger = t["ledger"]
    own = ledger if app is None else ledger.where(F.col("application_id") == app)
    return reconcile.reconcile(t["submissions"], own, ledger, t["assignments"], app=app)


def _view(t: Tables) -> DataFrame:
    return identity.evidence_view(t["intake"], t["messages"], t["agents"], t["applications"])


def _claims(t: Tables) -> DataFrame:
    return reconcile.claims_in_scope(t["submissions"], APP)


def _text(*columns: str):
    """Array columns as text, for comparison."""
    return [F.array_join(c, "|").alias(c) for c in columns]


# --- sources and sinks --------------------------------------------------------

@query
def q_read_tabular(t: Tables) -> DataFrame:
    path = scratch(t.spark, "tabular")
    t["raw_rows"].withColumnRenamed("row_number", "line").write.csv(path, header=True, escape='"')
    return readers.read_tabular(t.spark, path, RAW_MAPPING).select(
        F.col("line").cast("bigint").alias("line"), "raw_id", "raw_date", "agent", "locality"
    )


@query
def q_read_chat_log(t: Tables) -> DataFrame:
    path = scratch(t.spark, "chat")
    lines = t.sql("""
select case event_id%4 when 0 then concat(date_format(ts, 'dd/MM/yyyy, HH:mm'), ' - Agent ', user_id, ': photo IMG_', event_id, '.jpg')
 when 1 then concat('[', date_format(ts, 'dd/MM/yyyy, HH:mm:ss'), '] Agent ', user_id, ': image omitted')
 when 2 then concat(date_format(ts, 'dd/MM/yy, HH:mm'), ' - Agent ', user_id, ': bonjour') else 'suite du message' end as value
from events""")
    lines.write.text(path)
    return readers.read_chat_log(t.spark, path)


@query
def q_file_manifest(t: Tables) -> DataFrame:
    return readers.file_manifest(t.spark, t.sf_dir, [".parquet"]).select("name", "ext", "size")


@query
def q_read_messages(t: Tables) -> DataFrame:
    feed_rows = readers.read_messages(t.spark, t.sf_dir, pattern="events.parquet")
    return feed_rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


@query
def q_import_expected(t: Tables) -> DataFrame:
    added, present = imports.import_expected(t["typed_ids"], t["expected_ids"], 0, APP)
    return added.withColumn("outcome", F.lit("added")).unionByName(
        present.withColumn("outcome", F.lit("already_present"))
    )


@query
def q_import_agents(t: Tables) -> DataFrame:
    valid, rejects = imports.import_agents(t["agent_rows"])
    return valid.unionByName(rejects, allowMissingColumns=True)


@query
def q_report_sheets(t: Tables) -> DataFrame:
    return reports.report_sheets(_results(t), t["intake"], t["ledger"])


@query
def q_safe_csv_sink(t: Tables) -> DataFrame:
    path = scratch(t.spark, "export")
    rows = t.sql("""
select c_custkey, case c_custkey%4 when 0 then concat('=', c_name) when 1 then concat('  @', c_name)
 when 2 then concat('-', c_name) else nullif(c_name, c_name) end as agent, concat(c_mktsegment, '; "x"') as locality
from customer""")
    sinks.safe_csv_sink(rows, path)
    back = t.spark.read.csv(path, header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False)
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"),
                       F.coalesce("agent", F.lit("")).alias("agent"), "locality")


@query
def q_export_ids(t: Tables) -> DataFrame:
    return listing.export_ids(t["intake"], None, START, END)


@query
def q_export_ids_detailed(t: Tables) -> DataFrame:
    rows = identity.origin_lookup(t["intake"], t["messages"], t["channels"], t["agents"])
    return listing.export_ids(rows, APP, START, END, detailed=True)


# --- projections, filters, predicates -----------------------------------------------

@query
def q_effective_values(t: Tables) -> DataFrame:
    rows = t["intake"].drop("group_id", "sync_date")
    return P.effective_values(rows).select("evidence_id", "group_id", "sync_date")


@query
def q_usable_filter(t: Tables) -> DataFrame:
    return t["submissions"].where(P.usable_filter()).select("evidence_id", "application_id", "group_id")


@query
def q_report_category(t: Tables) -> DataFrame:
    return P.report_category(t["submissions"]).select("evidence_id", "category", "sync_visible", "sync_review")


@query
def q_readable_filter(t: Tables) -> DataFrame:
    return t["submissions"].where(P.readable_filter()).select("evidence_id", "confidence")


@query
def q_evidence_state(t: Tables) -> DataFrame:
    return P.evidence_state(t["submissions"]).select("evidence_id", "state")


@query
def q_evidence_day(t: Tables) -> DataFrame:
    return P.evidence_day(t["submissions"]).select("evidence_id", "day", "day_basis")


@query
def q_problem_reason(t: Tables) -> DataFrame:
    return P.problem_reason(t["submissions"]).select("evidence_id", "reason")


@query
def q_period_filter(t: Tables) -> DataFrame:
    return t["submissions"].where(P.period_filter(F.col("received_at"), START, END)).select("evidence_id")


@query
def q_claim_period_filter(t: Tables) -> DataFrame:
    inside = P.claim_period_filter(F.col("sync_date"), F.col("received_at"), START, END)
    return t["submissions"].where(inside).select("evidence_id", "sync_date")


@query
def q_operational_filter(t: Tables) -> DataFrame:
    q = datasets.OperationQuery(
        "evidence", START, END, application="suivi a", group="ZONE-1", status="NOT_VALIDATED"
    )
    return datasets.operational_filter(_view(t), q).select("evidence_id", "application", "group", "status")


@query
def q_list_evidence(t: Tables) -> DataFrame:
    rows = listing.list_evidence(
        t["submissions"], limit=50, offset=20, report_status="NOT_VALIDATED", start=START, end=END, media_type="image"
    )
    return rows.select("evidence_id", "received_at", "application_id", "processing_status")


@query
def q_list_results(t: Tables) -> DataFrame:
    return listing.list_results(_results(t), group_id="gr8.zone-6", limit=200).select(
        "evidence_id", "row_id", "status", "whatsapp_group_id", "dashboard_group_id"
    )


@query
def q_list_cases(t: Tables) -> DataFrame:
    return listing.list_cases(
        t["open_cases"], t["proofs"], t["attempts"], NOW, view="WAITING", delay=5, limit=100
    ).select("case_evidence_id", "status", "created_at")


@query
def q_list_messages(t: Tables) -> DataFrame:
    return listing.list_messages(t["messages"], download_status="FAILED", limit=100, offset=10).select(
        "message_id", "evidence_id", "message_date", "channel_id"
    )


@query
def q_list_audit(t: Tables) -> DataFrame:
    return listing.list_audit(t["audit"], action="purchase", limit=100)


@query
def q_search_channels(t: Tables) -> DataFrame:
    return listing.search_channels(t["channels"], "tion_1").select("channel_id", "name")


@query
def q_cutoff_filter(t: Tables) -> DataFrame:
    return t["messages"].select("evidence_id", P.cutoff_filter(F.col("message_date"), CUTOFF).alias("is_late"))


@query
def q_scope_guard(t: Tables) -> DataFrame:
    asked = t.sql("""
select evidence_id, case evidence_id%3 when 0 then 'coverage' when 1 then 'evidence' else 'followups' end as dataset,
 case when evidence_id%4=0 then 'all' else 'selected' end as scope, cast(received_at as date) as first_day,
 date_add(cast(received_at as date), cast(evidence_id%120 - 10 as int)) as last_day from submissions""")
    problem = datasets.scope_problem(F.col("dataset"), F.col("scope"), F.col("first_day"), F.col("last_day"), max_days=93)
    return asked.select("evidence_id", problem.alias("problem"))


# --- joins ------------------------------------------------------------------------

@query
def q_join_extraction(t: Tables) -> DataFrame:
    files = t["submissions"].select("evidence_id", "received_at", "processing_status", "duplicate_of_id")
    extractions = t["submissions"].select("evidence_id", "group_id", "sync_date", "sync_status")
    return identity.join_extraction(files, extractions).drop("duplicate_of_id")


@query
def q_join_sender(t: Tables) -> DataFrame:
    return identity.join_sender(t["submissions"], t["messages"]).select("evidence_id", "sender_external_id")


@query
def q_origin_lookup(t: Tables) -> DataFrame:
    rows = identity.origin_lookup(t["intake"], t["messages"], t["channels"], t["agents"])
    return rows.select("evidence_id", "channel_id", "channel_name", "agent_name")


@query
def q_resolve_identity(t: Tables) -> DataFrame:
    return identity.resolve_identity(t["intake"], t["messages"], t["agents"])


@query
def q_resolve_agent(t: Tables) -> DataFrame:
    return identity.resolve_agent(t["messages"], t["agents"]).select("evidence_id", "agent_id")


@query
def q_evidence_view(t: Tables) -> DataFrame:
    return _view(t).drop("duplicate_of_id", "received_at")


@query
def q_ledger_anti(t: Tables) -> DataFrame:
    own = t["ledger"].where(F.col("application_id") == APP)
    return reconcile.ledger_anti(own, _claims(t)).select("row_id", "group_id", "sync_date")


@query
def q_wrong_application(t: Tables) -> DataFrame:
    return reconcile.wrong_application(_claims(t), t["ledger"], APP).select(
        "evidence_id", "group_id", "in_other_application"
    )


@query
def q_unknown_group(t: Tables) -> DataFrame:
    return reconcile.unknown_group(_claims(t), t["assignments"], APP).select("evidence_id", "group_id", "is_unknown")


@query
def q_nearest_date_match(t: Tables) -> DataFrame:
    claims = reconcile.claims_in_scope(t["submissions"]).where("sync_date IS NOT NULL")
    return reconcile.nearest_date_match(claims, t["ledger"])


@query
def q_reconcile(t: Tables) -> DataFrame:
    return _results(t).drop("locality")


@query
def q_reconcile_period(t: Tables) -> DataFrame:
    ledger = t["ledger"].withColumn("application_id", F.lit(None).cast("string"))
    return reconcile.reconcile(
        t["submissions"], ledger, t["ledger"], t["assignments"], None, START, END, tolerance_days=2
    ).drop("locality")


@query
def q_asof_forward_match(t: Tables) -> DataFrame:
    rows = t["proofs"].where(identity.has_report_key())
    return timeline.asof_forward_match(
        rows.where(P.reason().isNotNull()), rows.where(P.usable_filter()), identity.KEY
    )


@query
def q_match_guards(t: Tables) -> DataFrame:
    near = t.sql("""
select a.evidence_id, b.evidence_id as replacement_id from proofs a join proofs b on a.sender_identity=b.sender_identity
 and a.group_id=b.group_id and a.sync_date=b.sync_date and a.evidence_id<b.evidence_id""")
    return cases.match_guards(near, t["proofs"])


@query
def q_manual_link_check(t: Tables) -> DataFrame:
    near = t.sql("""
select a.evidence_id, b.evidence_id as replacement_id from proofs a join proofs b on a.sender_identity=b.sender_identity
 and coalesce(a.group_id, 'none')=coalesce(b.group_id, 'none') and cast(a.received_at as date)=cast(b.received_at as date) and a.evidence_id<b.evidence_id""")
    return cases.manual_link_check(near, t["proofs"])


@query
def q_returned_after_reminder(t: Tables) -> DataFrame:
    return cases.returned_after_reminder(t["open_cases"], t["proofs"], t["attempts"]).select(
        "case_evidence_id", "returned_count"
    )


@query
def q_coverage(t: Tables) -> DataFrame:
    return coverage.coverage(_view(t), t["ledger"], START, END, "daily").drop("agent_id")


@query
def q_coverage_period(t: Tables) -> DataFrame:
    return coverage.coverage(_view(t), t["ledger"], START, END, "period").drop("agent_id")


@query
def q_ledger_presence(t: Tables) -> DataFrame:
    view = _view(t).where("status <> 'DUPLICATE' AND date_basis = 'report_date' AND sender_identity IS NOT NULL")
    view = view.where("application_id IS NOT NULL AND `group` IS NOT NULL")
    best = coverage.best_status(view.withColumn("day", F.col("date")), [*coverage.PARTICIPANT, "day"])
    return coverage.ledger_presence(best, t["ledger"]).select("evidence_id", "day", "dashboard_present")


def _project(t: Tables) -> DataFrame:
    return grid.project_submissions(t["submissions"], t["messages"], t["links"], 0, START, END)


@query
def q_project_grid(t: Tables) -> DataFrame:
    return grid.project_grid(t["expected_ids"], _project(t), START, END, "daily")


@query
def q_project_grid_weekly(t: Tables) -> DataFrame:
    return grid.project_grid(t["expected_ids"], _project(t), START, END, "weekly", APP)


@query
def q_case_history_join(t: Tables) -> DataFrame:
    return cases.case_history_join(t["attempts"], t["open_cases"], t["submissions"], "week", "2024-01-18")


@query
def q_channel_links(t: Tables) -> DataFrame:
    return grid.channel_links(t["channels"], t["links"])


@query
def q_channel_conflict(t: Tables) -> DataFrame:
    return grid.channel_conflict(t["channels"].select("channel_id", "name"), t["links"], 1)


@query
def q_fuzzy_id_match(t: Tables) -> DataFrame:
    read = t["raw_rows"].select(ids.normalize_id(F.col("raw_id"))["normalized"].alias("id"))
    known = t["ledger"].select("group_id")
    out = matching.fuzzy_id_match(read.where("id IS NOT NULL"), known, "levenshtein", threshold=70, margin=5)
    return out.select("id", "best_id", F.round("best_score", 4).alias("best_score"), "accepted")


@query
def q_fuzzy_id_match_indel(t: Tables) -> DataFrame:
    read = t["raw_rows"].select(ids.normalize_id(F.col("raw_id"))["normalized"].alias("id"))
    return matching.fuzzy_id_match(
        read.where("id IS NOT NULL"), t["ledger"].select("group_id"), metric="indel", threshold=82, margin=2
    ).drop("candidates")


@query
def q_fuzzy_id_match_weighted(t: Tables) -> DataFrame:
    read = t["raw_rows"].select(ids.normalize_id(F.col("raw_id"))["normalized"].alias("id"))
    short = t["ledger"].select(F.expr("concat('ouest', substring(group_id, 1, 6))").alias("id"))  # parts of known ids, and more
    found = matching.fuzzy_id_match(
        read.where("id IS NOT NULL").unionByName(short), t["ledger"].select("group_id").unionByName(t["ledger"].select(
            F.expr("concat('zone-ouest', group_id, '.region-', length(group_id))").alias("group_id")
        )), threshold=86, margin=2,
    )
    return found.select(
        "id", "best_id", F.round("best_score", 6).alias("best_score"), F.round("second_score", 6).alias("second_score"), "accepted", "needs_review",
        F.array_join(F.transform("candidates", lambda c: c["known"]), " ").alias("candidates"),
    )


@query
def q_detect_application(t: Tables) -> DataFrame:
    return matching.detect_application(t["texts"], REGISTRY, fuzzy=False).select(
        "evidence_id", "application_id", "detection_score"
    )


@query
def q_detect_application_fuzzy(t: Tables) -> DataFrame:
    return matching.detect_application(t["texts"], REGISTRY, fuzzy=True).select(
        "evidence_id", "application_id", F.round("detection_score", 3).alias("detection_score")
    )


@query
def q_attach_media(t: Tables) -> DataFrame:
    return matching.attach_media(t["chat_messages"], t["media_files"])


# --- aggregations -------------------------------------------------------------------

@query
def q_run_summary(t: Tables) -> DataFrame:
    return reconcile.run_summary(_results(t))


@query
def q_status_share(t: Tables) -> DataFrame:
    return stats.status_share(_results(t))


@query
def q_overview(t: Tables) -> DataFrame:
    return stats.overview(t["submissions"], _results(t))


@query
def q_overview_period(t: Tables) -> DataFrame:
    return stats.overview(t["submissions"], _results(t), START, END)


@query
def q_by_application(t: Tables) -> DataFrame:
    return stats.by_application(t["applications"], t["submissions"], _results(t), START, END)


@query
def q_by_period(t: Tables) -> DataFrame:
    parts = [
        stats.by_period(t["submissions"], g, NOW, days).withColumn("granularity", F.lit(g))
        for g, days in (("day", 20), ("week", None), ("month", None))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def q_anomalies(t: Tables) -> DataFrame:
    return stats.anomalies(_results(t), t["submissions"])


@query
def q_anomalies_period(t: Tables) -> DataFrame:
    return stats.anomalies(_results(t), t["submissions"], START, END)


@query
def q_operational_totals(t: Tables) -> DataFrame:
    return stats.operational_totals(_view(t))


@query
def q_channel_stats(t: Tables) -> DataFrame:
    return stats.channel_stats(t["channels"], t["messages"], TODAY)


@query
def q_queue_summary(t: Tables) -> DataFrame:
    busy = t["submissions"].withColumn(
        "processing_status",
        F.when(F.col("processing_status") == "PENDING", "QUEUED").otherwise(F.col("processing_status")),
    )
    return stats.queue_summary(t["messages"], busy)


@query
def q_import_totals(t: Tables) -> DataFrame:
    return imports.import_totals(imports.import_dups(imports.read_rows(t["raw_rows"], RAW_MAPPING)))


@query
def q_frequent_recipients(t: Tables) -> DataFrame:
    return stats.frequent_recipients(t["attempts"], TODAY)


@query
def q_case_send_stats(t: Tables) -> DataFrame:
    return cases.case_send_stats(t["open_cases"], t["proofs"], t["attempts"], NOW)


@query
def q_campaign_stats(t: Tables) -> DataFrame:
    return stats.campaign_stats(t["campaigns"], TODAY)


@query
def q_campaign_recipients(t: Tables) -> DataFrame:
    return stats.campaign_recipients(t["campaigns"])


@query
def q_campaign_runs(t: Tables) -> DataFrame:
    return stats.campaign_runs(t["campaign_runs"])


@query
def q_reminder_digest(t: Tables) -> DataFrame:
    return reminders.reminder_digest(
        t["open_cases"], t["contacts"], t["attempts"], t["campaigns"], t["agents"], t["applications"], TODAY
    )


@query
def q_project_totals(t: Tables) -> DataFrame:
    rows = _project(t)
    return grid.project_totals(rows, grid.project_grid(t["expected_ids"], rows, START, END, "daily"))


@query
def q_project_by_application(t: Tables) -> DataFrame:
    return grid.project_by_application(_project(t))


@query
def q_job_health(t: Tables) -> DataFrame:
    return stats.job_health(t["jobs"])


@query
def q_registry_totals(t: Tables) -> DataFrame:
    return stats.registry_totals(agents=t["agents"], applications=t["applications"])


@query
def q_confidence_rollup(t: Tables) -> DataFrame:
    return stats.confidence_rollup(t["readings"], ["id_confidence", "date_confidence", "sync_confidence"])


@query
def q_keyword_union(t: Tables) -> DataFrame:
    profiles = t.sql("""
select s_suppkey as profile_id, s_acctbal > 0 as is_active,
 array(concat('mot', cast(s_nationkey as string)), 'success', concat('cle', cast(s_suppkey%20 as string))) as keywords
from supplier""")
    return stats.keyword_union(profiles, K.SUCCESS_KEYWORDS)


@query
def q_agents_nested(t: Tables) -> DataFrame:
    return stats.agents_nested(t["agents"], t["agent_groups"])


@query
def q_case_groups(t: Tables) -> DataFrame:
    return cases.case_groups(t["open_cases"], t["proofs"]).select(
        "case_evidence_id", "case_count", "resolved", "replacement_evidence_id"
    )


# --- windows --------------------------------------------------------------------------

@query
def q_dup_claims(t: Tables) -> DataFrame:
    return reconcile.dup_claims(_claims(t)).select("evidence_id", "is_repeat")


@query
def q_dup_ledger(t: Tables) -> DataFrame:
    return reconcile.dup_ledger(t["ledger"]).select("row_id", "n")


@query
def q_import_dups(t: Tables) -> DataFrame:
    rows = imports.read_rows(t["raw_rows"], RAW_MAPPING)
    return imports.import_dups(rows).select("row_number", "normalized_group_id", "is_duplicate")


@query
def q_content_dedup(t: Tables) -> DataFrame:
    files = t["documents"].withColumn("sha256", F.when(F.col("doc_id") % 11 != 0, F.sha2("text", 256)))
    return windows.content_dedup(files, "sha256", ["doc_id"], "doc_id").select("doc_id", "sha256", "duplicate_of_id")


@query
def q_latest_run(t: Tables) -> DataFrame:
    runs = t["jobs"].withColumnRenamed("job_id", "run_id")
    return windows.latest_run(runs).select("run_id", "finished_at")


@query
def q_best_status(t: Tables) -> DataFrame:
    rows = P.evidence_day(P.evidence_state(t["submissions"])).where("state <> 'DUPLICATE'").select(
        "evidence_id", "received_at", "user_id", F.col("state").alias("status"), F.col("day").alias("date")
    )
    return coverage.best_status(rows, ["user_id"])


@query
def q_first_observation(t: Tables) -> DataFrame:
    return coverage.first_observation(_view(t), END).drop("agent_id")


@query
def q_latest_explicit_state(t: Tables) -> DataFrame:
    rows = t["frames"].withColumn("read", status.sync_text_status(F.col("text"), fuzzy=False)).select(
        "proof_id", "frame_id", frames.frame_time(t["frames"]).alias("at_time"),
        F.when(F.col("read.matched").isNotNull(), F.col("read.status")).alias("state"),
    )
    return windows.latest_explicit_state(rows)


@query
def q_state_changes(t: Tables) -> DataFrame:
    return windows.state_changes(t["events"], "user_id", "ts", "event_type", "event_id").select(
        "event_id", "user_id", "event_type", "previous_state"
    )


@query
def q_best_reading(t: Tables) -> DataFrame:
    return windows.best_reading(t["readings"])


@query
def q_representative_picks(t: Tables) -> DataFrame:
    return windows.representative_picks(t["shots"]).select("proof_id", "pick", "frame_id")


@query
def q_best_frame(t: Tables) -> DataFrame:
    return windows.best_frame(t["frames"])


@query
def q_budget_select(t: Tables) -> DataFrame:
    return windows.budget_select(t["images"])


# --- order, limit, sets -----------------------------------------------------------------

@query
def q_page(t: Tables) -> DataFrame:
    rows = t["documents"].select("doc_id", "lang", "n_chars")
    return listing.page(rows, [F.col("n_chars").desc(), "doc_id"], 50, 25)


@query
def q_list_recent(t: Tables) -> DataFrame:
    return listing.list_recent(t["jobs"].select("job_id", "status", "finished_at"), "finished_at", 50, "job_id")


@query
def q_top_failures(t: Tables) -> DataFrame:
    return listing.top_failures(t["jobs"]).select("job_id", "job_type", "finished_at")


@query
def q_sorted_ids(t: Tables) -> DataFrame:
    return listing.sorted_ids(t["submissions"])


@query
def q_result_union(t: Tables) -> DataFrame:
    claims = _claims(t).select("evidence_id", F.lit("claim").alias("side"))
    rows = t["ledger"].select("row_id", F.lit("ledger").alias("side"))
    return reconcile.result_union(claims, rows)


@query
def q_retention_plan(t: Tables) -> DataFrame:
    return listing.retention_plan(t["intake"], t["frame_files"], t["jobs"], NOW)


@query
def q_new_ids(t: Tables) -> DataFrame:
    keys = t["typed_ids"].select(text.business_key(F.col("value")).alias("business_id"))
    return listing.new_ids(keys, t["expected_ids"].select("business_id"))


# --- scalar functions --------------------------------------------------------------------

@query
def q_fold_text(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.md5(text.fold_text(F.col("text"))).alias("folded"))


@query
def q_find_id_candidates(t: Tables) -> DataFrame:
    found = ids.find_id_candidates(F.col("text"))
    return t["documents"].select("doc_id", F.size(found).alias("n").cast("bigint"), F.array_join(found, "|").alias("candidates"))


@query
def q_normalize_id(t: Tables) -> DataFrame:
    n = ids.normalize_id(F.col("raw_id"))
    return t["raw_rows"].select(
        "row_number", n["normalized"].alias("normalized"), n["valid"].alias("valid"),
        n["confidence"].alias("confidence"), F.array_join(n["corrections"], "|").alias("corrections"),
    )


@query
def q_find_date_candidates(t: Tables) -> DataFrame:
    found = dates.find_date_candidates(F.concat_ws(" ", "raw_id", "raw_date", "agent"))
    return t["raw_rows"].select("row_number", F.array_join(found, "|").alias("candidates"))


@query
def q_parse_report_date(t: Tables) -> DataFrame:
    d = dates.parse_report_date(F.col("raw_date"), F.when(F.col("row_number") % 2 == 0, F.lit("2024-01-15")))
    return t["raw_rows"].select("row_number", d.alias("d")).select(
        "row_number", "d.raw_text", "d.normalized_date", "d.is_ambiguous", "d.missing_year", "d.confidence"
    )


@query
def q_sync_text_status(t: Tables) -> DataFrame:
    s = status.sync_text_status(F.col("text"), fuzzy=False)
    return t["texts"].select("evidence_id", s.alias("s")).select("evidence_id", "s.status", "s.matched", "s.confidence")


@query
def q_sync_text_status_fuzzy(t: Tables) -> DataFrame:
    s = status.sync_text_status(F.col("text"), fuzzy=True)
    return t["documents"].select("doc_id", s.alias("s")).select("doc_id", "s.status", "s.matched")


@query
def q_extraction_outcome(t: Tables) -> DataFrame:
    return frames.extraction_outcome(t["scans"], t["ledger"].select("group_id"))


@query
def q_phone_key(t: Tables) -> DataFrame:
    return t["messages"].select(
        "evidence_id", text.phone_key(F.col("sender_phone")).alias("phone"),
        text.phone_key(F.col("sender_external_id")).alias("address_phone"),
    )


@query
def q_recipient(t: Tables) -> DataFrame:
    return t["messages"].select(
        "evidence_id", text.recipient(F.col("sender_external_id"), F.col("sender_phone")).alias("recipient")
    )


@query
def q_recipient_of_agent(t: Tables) -> DataFrame:
    return cases.with_recipient(t["contacts"], t["agents"]).select("evidence_id", "recipient")


@query
def q_import_errors(t: Tables) -> DataFrame:
    rows, _ = imports.import_ledger(t["raw_rows"], RAW_MAPPING)
    return imports.error_report(rows).select("row_number", "raw_group_id", *_text("validation_errors"))


@query
def q_complete_usable(t: Tables) -> DataFrame:
    return cases.complete_usable(t["proofs"]).select("evidence_id", "processing_status")


@query
def q_business_key(t: Tables) -> DataFrame:
    return t["raw_rows"].select("row_number", text.business_key(F.col("raw_id")).alias("business_id"))


@query
def q_media_kind(t: Tables) -> DataFrame:
    return t["media_files"].select("file_name", text.media_kind(F.col("file_name")).alias("kind"))


@query
def q_week_start(t: Tables) -> DataFrame:
    return t["events"].select("event_id", text.week_start(F.col("ts")).alias("week"))


@query
def q_month_key(t: Tables) -> DataFrame:
    return t["orders"].select("o_orderkey", text.month_key(F.col("o_orderdate")).alias("month"))


@query
def q_suggested_message(t: Tables) -> DataFrame:
    body = text.suggested_message(
        F.col("sender_name"), F.col("name"), F.col("group_id"), F.col("sync_date"), F.col("sync_status"), F.col("evidence_id"),
    )
    names = t["applications"].select("application_id", "name")
    return t["intake"].join(names, "application_id", "left").select("evidence_id", body.alias("body"))


@query
def q_append_history(t: Tables) -> DataFrame:
    entry = F.struct(F.col("received_at").alias("at"), F.col("group_id").alias("previous_group"))
    past = F.when(F.col("evidence_id") % 2 == 0, F.array(entry))
    return t["submissions"].select("evidence_id", F.size(text.append_history(past, entry)).cast("bigint").alias("entries"))


@query
def q_validation_errors(t: Tables) -> DataFrame:
    rows = imports.read_rows(t["raw_rows"], RAW_MAPPING)
    return rows.select("row_number", "is_valid", *_text("validation_errors"))


@query
def q_notification_panel(t: Tables) -> DataFrame:
    return t["frames"].select("frame_id", text.notification_panel(F.col("text")).alias("is_panel"))


# --- pipelines --------------------------------------------------------------------------------

@query
def q_import_ledger(t: Tables) -> DataFrame:
    rows, _ = imports.import_ledger(t["raw_rows"], RAW_MAPPING)
    return rows.drop("extra_fields", "declared_group_id", "status_raw").withColumn(
        "validation_errors", F.array_join("validation_errors", "|")
    )


@query
def q_frame_state(t: Tables) -> DataFrame:
    return frames.frame_state(t["frames"], t["proof_apps"])


@query
def q_apply_reviews(t: Tables) -> DataFrame:
    return reviews.apply_reviews(t["submissions"], t["review_events"]).select(
        "evidence_id", "group_id", "sync_date", "date_is_ambiguous", "requires_review", "sync_status",
        "processing_status",
    )


@query
def q_review_history(t: Tables) -> DataFrame:
    return reviews.review_history(t["review_events"])


@query
def q_evidence_dataset(t: Tables) -> DataFrame:
    q = datasets.OperationQuery("evidence", START, END, locality="A")
    return datasets.evidence_dataset(t.operations(), q)[0].select(
        "evidence_id", "agent", "locality", "application", "date", "status"
    )


@query
def q_followup_dataset(t: Tables) -> DataFrame:
    q = datasets.OperationQuery("followups", START, END, scope="all")
    return datasets.followup_dataset(t.operations(), q)[0].select(
        "case_evidence_id", "case_count", "status", "returned_count", "attempt_count", "last_send_status",
        "uncertain_send", "replacement_evidence_id", "reason", "agent",
    )


@query
def q_coverage_dataset(t: Tables) -> DataFrame:
    q = datasets.OperationQuery("coverage", START, END, status="MISSING", agent="supplier")
    return datasets.coverage_dataset(t.operations(), q)[0].select(
        "sender_identity", "application", "group", "date", "status"
    )


@query
def q_rebuild_cases(t: Tables) -> DataFrame:
    return cases.rebuild_cases(t["prior_cases"], t["proofs"], NOW).select(
        "case_evidence_id", "status", "replacement_evidence_id", "reason"
    )


@query
def q_rebuild_followups(t: Tables) -> DataFrame:
    rebuilt, completed = cases.rebuild_followups(t["prior_cases"], t["proofs"], NOW)
    own = rebuilt.select(F.col("case_evidence_id").alias("evidence_id"), F.col("status").alias("case_status"), "replacement_evidence_id")
    return completed.select("evidence_id", "processing_status").join(own, "evidence_id", "left")


@query
def q_reminder_candidates(t: Tables) -> DataFrame:
    asked = t["open_cases"].select("case_evidence_id")
    return reminders.reminder_candidates(asked, t["open_cases"], t["contacts"], t["attempts"], t["agents"], NOW)


@query
def q_prepare_drafts(t: Tables) -> DataFrame:
    return reminders.prepare_drafts(t["open_cases"], t["contacts"], t["attempts"], t["agents"], t["applications"], NOW)


# --- streaming -----------------------------------------------------------------------------------

_STREAM_MESSAGES = """
select concat('m', cast(case when event_id%20=1 then event_id-1 else event_id end as string)) as message_id,
 event_id%27 as channel_id, cast(ts as timestamp) as message_date, event_id as evidence_id,
 case when event_id%11=0 then 'FAILED' when event_id%12=0 then 'PENDING' else 'DOWNLOADED' end as download_status,
 case when event_id%14=0 then null else concat('inbox/', cast(event_id as string), '.jpg') end as storage_path,
 md5(concat(cast(user_id as string), '-', regexp_extract(props, '([0-9]+)', 1))) as sha256,
 user_id, event_type, ts
from {stream}"""


def _message_stream(t: Tables) -> DataFrame:
    stream = readers.read_messages(t.spark, t.sf_dir, streaming=True, pattern="events.parquet")
    return t.spark.sql(_STREAM_MESSAGES, stream=stream)


def _in_parts(t: Tables, rows: DataFrame, root: str, parts: int = 4) -> DataFrame:
    """A stream of the rows in as many micro-batches, dealt by hash and so out of their order in time."""
    rows.withColumn("part", F.pmod(F.xxhash64(F.col(rows.columns[0])), F.lit(parts))).repartition("part").sortWithinPartitions(
        "part").write.partitionBy("part").parquet(f"{root}/incoming")
    schema = t.spark.read.parquet(f"{root}/incoming").schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/incoming").drop("part")


def _run_to_table(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    root = scratch(t.spark, label)
    feed.run_available(stream, f"{root}/checkpoint", f"{root}/rows")
    return t.spark.read.parquet(f"{root}/rows")


@query
def q_stream_dedup(t: Tables) -> DataFrame:
    root = scratch(t.spark, "dedup-in")
    parts = _in_parts(t, t["messages"].select("evidence_id", "message_id", "message_date"), root)
    return _run_to_table(t, feed.stream_dedup(parts), "dedup").select("message_id")


@query
def q_stream_dedup_tables(t: Tables) -> DataFrame:
    root = scratch(t.spark, "dedup-tables")
    parts = _in_parts(t, t["messages"].select("evidence_id", "message_id", "message_date"), root)
    feed.run_available(parts, f"{root}/checkpoint", feed.dedup_sink(f"{root}/state"))
    return feed.read_batches(t.spark, f"{root}/state/new").select("message_id")


@query
def q_stream_route(t: Tables) -> DataFrame:
    routed = feed.stream_route(_message_stream(t), t["channels"], CUTOFF)
    return _run_to_table(t, routed, "route").select("evidence_id", "route", "route_note")


@query
def q_stream_late(t: Tables) -> DataFrame:
    return _run_to_table(t, feed.stream_late(_message_stream(t), CUTOFF), "late").select("evidence_id", "is_late")


@query
def q_discover_channels(t: Tables) -> DataFrame:
    return feed.discover_channels(t["messages"], t["channels"])


@query
def q_stream_content_dedup(t: Tables) -> DataFrame:
    root = scratch(t.spark, "content")
    stream = _message_stream(t).select("evidence_id", F.col("ts").alias("received_at"), "sha256")
    feed.run_available(stream, f"{root}/checkpoint", feed.content_dedup_sink(root))
    return feed.read_batches(t.spark, f"{root}/files").select("evidence_id", "sha256", "duplicate_of_id")


@query
def q_stream_case_state(t: Tables) -> DataFrame:
    root = scratch(t.spark, "cases")
    stream = _in_parts(t, t["proofs"], root, parts=2)
    feed.run_available(stream, f"{root}/checkpoint", feed.case_state_sink(root, t["prior_cases"], NOW))
    return feed.latest_rows(feed.read_batches(t.spark, f"{root}/cases"), ["case_evidence_id"]).select(
        "case_evidence_id", "status", "replacement_evidence_id", "reason"
    )


@query
def q_gateway_transitions(t: Tables) -> DataFrame:
    return feed.gateway_transitions(t["gateway"]).select(
        "event_id", "gateway_id", "connection_state", "previous_state"
    )


@query
def q_stream_gateway(t: Tables) -> DataFrame:
    root = scratch(t.spark, "gateway")
    feed.run_available(_in_parts(t, t["gateway"], root), f"{root}/checkpoint", feed.gateway_sink(root))
    return feed.gateway_changes(t.spark, root).select(
        "event_id", "gateway_id", "connection_state", "previous_state"
    )


@query
def q_incremental_files(t: Tables) -> DataFrame:
    stream = readers.incremental_files(t.spark, t.sf_dir, [".parquet"])
    return _run_to_table(t, stream, "files").select("name", "ext", "size")


@query
def q_tumbling_counts(t: Tables) -> DataFrame:
    root = scratch(t.spark, "counts")
    parts = _in_parts(t, t["messages"].select("evidence_id", "message_date", "channel_id", "download_status"), root)
    counts = feed.tumbling_counts(parts)
    feed.run_available(counts, f"{root}/checkpoint", feed.upsert_sink(f"{root}/rows"), "update")
    return feed.latest_rows(feed.read_batches(t.spark, f"{root}/rows"), ["day", "channel_id"])


@query
def q_daily_digest(t: Tables) -> DataFrame:
    now = dt.datetime.fromisoformat("2024-01-17 22:30:00")
    return reminders.daily_digest(t["open_cases"], t["contacts"], t["attempts"], t["campaigns"], t["agents"], t["applications"], now)


@query
def q_retry_budget(t: Tables) -> DataFrame:
    retried, spent = feed.retry_budget(t["messages"])
    keep = ["evidence_id", "retry_count", "download_status"]
    return retried.select(*keep, F.lit("retry").alias("outcome")).unionByName(
        spent.select(*keep, F.lit("spent").alias("outcome"))
    )


@query
def q_indel_ratio(t: Tables) -> DataFrame:
    rows = t["raw_rows"].select("row_number", "raw_id", "agent")
    return rows.select(
        "row_number", F.round(similarity.indel_ratio(F.col("raw_id"), F.col("agent")), 3).alias("score")
    )
