import datetime as dt

import pytest

from proofline.functions import predicates as P
from proofline.operators import coverage as V
from proofline.operators import grid, identity, stats
from proofline.plans import datasets

AGENT = "agent_id bigint, full_name string, locality string, phone string, is_active boolean"
MESSAGE = "message_id string, channel_id bigint, message_date timestamp_ntz, evidence_id bigint, sender_external_id string"
APP = "application_id string, name string, is_active boolean"


@pytest.fixture
def tables(spark):
    def build(subs, agents=(), messages=(), ledger=()):
        return {
            "submissions": subs.drop("sender_identity", "sender_external_id"),
            "agents": spark.createDataFrame([(i, f"Agent {i}", "Nord", p, True) for i, p in agents], AGENT),
            "messages": spark.createDataFrame(
                [(f"m{i}", 1, dt.datetime(2026, 7, 30, 8), e, s) for i, (e, s) in enumerate(messages)], MESSAGE
            ),
            "applications": spark.createDataFrame([("a", "Suivi A", True)], APP),
            "ledger": spark.createDataFrame(
                [(i, a, g, d, True) for i, (a, g, d) in enumerate(ledger)],
                "row_id bigint, application_id string, group_id string, sync_date string, is_valid boolean",
            ),
        }

    return build


def view_of(t):
    return identity.evidence_view(t["submissions"], t["messages"], t["agents"], t["applications"])


def test_identity_needs_a_unique_candidate(spark, submissions, tables):
    subs = submissions(
        dict(agent_id=7), dict(sender_phone="70000001"), dict(sender_phone="70000002"), dict(sender_phone=None),
        dict(sender_phone="70000003", agent_id=9), dict(sender_phone="x"),
    )
    t = tables(
        subs, agents=[(1, "+70 000 001"), (2, "70000002"), (3, "70000002")],
        messages=[(4, "99@lid"), (5, "99@lid"), (6, "group@g.us")],
    )
    rows = identity.resolve_identity(t["submissions"], t["messages"], t["agents"]).collect()
    assert {r["evidence_id"]: r["sender_identity"] for r in rows} == {
        1: "7", 2: "1", 3: "70000002@c.us", 4: "9", 5: "9", 6: None
    }


def test_coverage_counts_a_day_once_and_ambiguous_dates_not_at_all(spark, submissions, tables):
    t = tables(submissions(dict(sync_status="FAILED"), dict()), ledger=[("a", "gr1.a", "2026-07-30")])
    day = dt.date(2026, 7, 30)
    row = V.coverage(view_of(t), t["ledger"], day, day).first()
    assert (row["status"], row["submission_count"], row["evidence_id"], row["dashboard_present"]) == (
        "SYNCHRONIZED", 2, 2, True
    )
    t = tables(submissions(dict(date_is_ambiguous=True)))
    assert V.coverage(view_of(t), t["ledger"], day, day).first()["status"] == "MISSING"


def test_daily_and_period_cadence(spark, submissions, tables):
    t = tables(submissions(dict()))
    first, last = dt.date(2026, 7, 29), dt.date(2026, 7, 31)
    daily = {r["date"]: r["status"] for r in V.coverage(view_of(t), t["ledger"], first, last).collect()}
    assert daily == {"2026-07-29": "MISSING", "2026-07-30": "SYNCHRONIZED", "2026-07-31": "MISSING"}
    whole = V.coverage(view_of(t), t["ledger"], first, last, "period").collect()
    assert [(r["status"], r["period_end"]) for r in whole] == [("SYNCHRONIZED", "2026-07-31")]


def test_scope_guard_raises_and_never_cuts(spark, submissions, tables):
    day = dt.date(2026, 7, 30)
    with pytest.raises(datasets.ScopeError):
        datasets.scope_guard(datasets.OperationQuery("evidence", day, day - dt.timedelta(days=1)))
    with pytest.raises(datasets.ScopeError):
        datasets.scope_guard(datasets.OperationQuery("evidence", day, day + dt.timedelta(days=93)), max_days=93)
    datasets.scope_guard(datasets.OperationQuery("evidence", day, day + dt.timedelta(days=92)), max_days=93)
    datasets.scope_guard(datasets.OperationQuery("evidence", day, day + dt.timedelta(days=9999)))
    with pytest.raises(datasets.ScopeError):
        datasets.scope_guard(datasets.OperationQuery("coverage", day, day, scope="all"))
    t = tables(submissions(dict()))
    rows, _ = datasets.coverage_dataset(t, datasets.OperationQuery("coverage", day, day + dt.timedelta(days=199)))
    assert rows.count() == 200


def test_status_aliases_and_totals(spark, submissions, tables):
    t = tables(submissions(
        dict(), dict(sync_status="FAILED"), dict(processing_status="REQUIRES_REVIEW"), dict(sender_phone=None),
    ))
    day = dt.date(2026, 7, 30)
    rows, totals = datasets.evidence_dataset(t, datasets.OperationQuery("evidence", day, day, status="NOT_VALIDATED"))
    assert [r["evidence_id"] for r in rows.collect()] == [2]
    rows, totals = datasets.evidence_dataset(t, datasets.OperationQuery("evidence", day, day, status="TO_REVIEW"))
    assert [r["evidence_id"] for r in rows.collect()] == [3]
    found = {r["measure"]: r["value"] for r in datasets.evidence_dataset(
        t, datasets.OperationQuery("evidence", day, day, application="suivi")
    )[1].collect()}
    assert found == {"status:SYNCHRONIZED": 3, "status:FAILED": 1, "registered_agents": 0, "unregistered_contacts": 1,
                     "total": 4, "unknown_sender_reports": 1, "review_queue": 1, "unattributed": 4}


def test_categories_partition_the_set(spark, submissions):
    subs = submissions(
        dict(), dict(processing_status="REQUIRES_REVIEW"), dict(sync_status="FAILED"), dict(processing_status="PENDING"),
        dict(processing_status="DUPLICATE", duplicate_of_id=1, sync_status=None),
    )
    rows = P.report_category(subs).collect()
    assert [r["category"] for r in rows] == ["VALID", "VALID", "NOT_VALIDATED", "PENDING", "DUPLICATE"]
    assert (sum(r["sync_visible"] for r in rows), sum(r["sync_review"] for r in rows)) == (2, 0)
    usable = subs.where(P.usable_filter()).count()
    assert usable == sum(r["category"] == "VALID" for r in rows)


def test_problem_reasons(spark, submissions):
    subs = submissions(
        dict(sync_status=None, raw_text=None, confidence=None, application_id=None, group_id=None, sync_date=None,
             date_is_ambiguous=None, processing_status="FAILED"),
        dict(processing_status="FAILED"), dict(processing_status="QUEUED", sync_status="FAILED"),
    )
    rows = [r["reason"] for r in P.problem_reason(subs).collect()]
    assert rows[0].count("; ") == 5 and rows[0].endswith("Synchronisation non confirmée")
    assert rows[1] == "Analyse impossible : vérifier le fichier et renvoyer une capture nette"
    assert rows[2] is None


def test_project_grid_daily_weekly_and_period(spark, submissions):
    start, end = dt.date(2026, 7, 30), dt.date(2026, 7, 31)
    received = submissions(dict(group_id=" GR1.A "), dict(duplicate_of_id=1, processing_status="DUPLICATE"), dict(group_id=None))
    expected = spark.createDataFrame([(1, "a", "gr1.a"), (1, "a", "gr2.b")], "project_id int, application_id string, business_id string")
    daily = grid.project_grid(expected, received, start, end, "daily")
    totals = grid.project_totals(received, daily).first()
    assert totals.asDict() == dict(received=3, valid=2, duplicates=1, unidentified=1, expected=4, missing=3)
    period = grid.project_grid(expected, received, start, end, "period")
    assert period.where("status = 'MISSING'").count() == 1
    weekly = grid.project_grid(expected, received, start, start + dt.timedelta(days=8), "weekly").collect()
    assert {(r["start"], r["end"]) for r in weekly} == {("2026-07-30", "2026-08-05"), ("2026-08-06", "2026-08-07")}


def test_overview_without_rows_and_share_rounding(spark, submissions):
    empty = submissions(dict()).limit(0)
    results = spark.createDataFrame([], "evidence_id bigint, application_id string, status string")
    row = stats.overview(empty, results).first()
    assert (row["total_evidence"], row["conformity_rate"], row["automatic_rate"]) == (0, 0.0, 0.0)
    three = spark.createDataFrame([("x",), ("x",), ("y",)], "status string")
    assert {r["status"]: r["percent"] for r in stats.status_share(three).collect()} == {"x": 66.7, "y": 33.3}


def test_agents_have_a_row_for_each_assignment(spark):
    agents = spark.createDataFrame([(1, "A"), (2, "B")], "agent_id bigint, full_name string")
    links = spark.createDataFrame([(1, "a", f"g{i}") for i in range(25)], "agent_id bigint, application_id string, group_id string")
    rows = stats.agents_nested(agents, links.unionByName(links)).collect()
    assert sorted(r["group_id"] for r in rows if r["agent_id"] == 1) == sorted(f"g{i}" for i in range(25))
    assert [r["group_id"] for r in rows if r["agent_id"] == 2] == [None]
