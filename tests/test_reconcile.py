import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofline.operators import reconcile as R

LEDGER = "row_id bigint, application_id string, group_id string, sync_date string, is_valid boolean, locality string"
ASSIGNED = "application_id string, group_id string"


@pytest.fixture
def ledger(spark):
    def build(*rows):
        full = [(i, r[0], r[1], r[2], r[3] if len(r) > 3 else True, "Zone") for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(full, LEDGER)

    return build


def statuses(results):
    return Counter(r["status"] for r in results.collect())


def run(spark, subs, ledger, ledger_all=None, assigned=(), app="a", **kw):
    assignments = spark.createDataFrame([(app or "a", g) for g in assigned], ASSIGNED)
    return R.reconcile(subs, ledger, ledger if ledger_all is None else ledger_all, assignments, app=app, **kw)


def test_one_scenario_with_eleven_statuses(spark, submissions, ledger):
    subs = submissions(
        dict(group_id="gr1.a"), dict(group_id="gr1.a"), dict(group_id="gr2.b"), dict(group_id=None),
        dict(group_id="gr3.c", sync_date=None), dict(group_id="gr4.d", sync_status="FAILED"),
        dict(group_id="gr5.e", sync_status="UNCONFIRMED"), dict(group_id="gr6.f", requires_review=True),
        dict(group_id="gr7.g", sync_date="2026-07-20"),
    )
    rows = ledger(("a", "gr1.a", "2026-07-30"), ("a", "gr7.g", "2026-07-30"), ("a", "gr8.h", "2026-07-30"),
                  ("a", "gr9.i", "2026-07-30"), ("a", "gr9.i", "2026-07-30"))
    assert statuses(run(spark, subs, rows)) == {
        "CONFORME": 1, "DOUBLON_WHATSAPP": 1, "DASHBOARD_SANS_PREUVE_WHATSAPP": 1, "DOUBLON_DASHBOARD": 2,
        "DECLARE_WHATSAPP_ABSENT_DASHBOARD": 1, "ID_ILLISIBLE": 1, "DATE_ILLISIBLE": 1,
        "ECHEC_SYNCHRONISATION": 1, "SYNCHRONISATION_NON_CONFIRMEE": 1, "VERIFICATION_MANUELLE": 1, "ECART_DATE": 1,
    }


def test_unknown_group_only_when_assignments_exist(spark, submissions, ledger):
    subs, rows = submissions(dict(group_id="gr9.x")), ledger(("a", "gr1.a", "2026-07-30"))
    assert statuses(run(spark, subs, rows, assigned=["gr1.a"]))["ID_INCONNU"] == 1
    assert statuses(run(spark, subs, rows))["DECLARE_WHATSAPP_ABSENT_DASHBOARD"] == 1


def test_wrong_application_counts_invalid_rows_of_any_import(spark, submissions, ledger):
    subs = submissions(dict(group_id="gr9.x"), dict(group_id="gr9.x"))
    everything = ledger(("b", "gr9.x", None, False))
    own = everything.where("application_id = 'a'")
    # The repeat counter only advances for claims that pass this gate.
    assert statuses(run(spark, subs, own, everything)) == {"MAUVAISE_APPLICATION": 2}


def test_other_dates_are_no_repeats_and_the_exact_row_wins(spark, submissions, ledger):
    subs = submissions(dict(sync_date="2026-07-29"), dict(sync_date="2026-07-30"))
    rows = ledger(("a", "gr1.a", "2026-07-29"), ("a", "gr1.a", "2026-07-30"))
    assert statuses(run(spark, subs, rows)) == {"CONFORME": 2}


def test_ambiguous_date_is_never_conform(spark, submissions, ledger):
    subs = submissions(dict(date_is_ambiguous=True))
    assert statuses(run(spark, subs, ledger(("a", "gr1.a", "2026-07-30")))) == {"VERIFICATION_MANUELLE": 1}


def test_tolerance_and_ties_and_undated_rows(spark, submissions, ledger):
    subs = submissions(dict())
    rows = ledger((None, "gr1.a", "2026-08-01"), ("a", "gr1.a", "2026-07-28"), ("a", "gr1.a", None))
    near = run(spark, subs, rows, tolerance_days=2).where("evidence_id is not null").first()
    assert (near["status"], near["row_id"]) == ("CONFORME", 1)
    assert run(spark, subs, rows, tolerance_days=1).first()["status"] == "ECART_DATE"
    undated = run(spark, subs, ledger(("a", "gr1.a", None), ("a", "gr1.a", "n/a"))).first()
    assert (undated["status"], undated["row_id"], undated["dashboard_date"]) == ("ECART_DATE", 1, None)


def test_period_uses_reception_only_without_a_report_date(spark, submissions, ledger):
    subs = submissions(
        dict(sync_date="2026-07-01"), dict(sync_date=None, received_at=dt.datetime(2026, 7, 30, 23, 59)),
        dict(sync_date=None, received_at=dt.datetime(2026, 8, 1)),
    )
    out = run(spark, subs, ledger(), start="2026-07-30", end="2026-07-31")
    assert [r["evidence_id"] for r in out.collect()] == [2]


def brute(claims, rows):
    out = {}
    for c in claims:
        options = [r for r in rows if r["group_id"] == c["group_id"] and r["application_id"] in (None, c["application_id"])]

        def gap(r):
            try:
                return abs((dt.date.fromisoformat(c["sync_date"]) - dt.date.fromisoformat(r["sync_date"])).days)
            except (TypeError, ValueError):
                return 10**9
        if options:
            out[c["evidence_id"]] = min(options, key=lambda r: (gap(r), r["row_id"]))["row_id"]
    return out


def test_nearest_date_equals_brute_force(spark, submissions, ledger):
    rng = random.Random(7)
    days = [f"2026-07-{d:02d}" for d in range(1, 29)]
    subs = submissions(*[
        dict(group_id=f"gr{rng.randint(1, 4)}.x", application_id=rng.choice("ab"), sync_date=rng.choice(days + ["?"]))
        for _ in range(120)
    ])
    rows = ledger(*[
        (rng.choice(["a", "b", None]), f"gr{rng.randint(1, 5)}.x", rng.choice(days + [None, "bad"])) for _ in range(40)
    ])
    got = {r["evidence_id"]: r["row_id"] for r in R.nearest_date_match(subs, rows).collect()}
    assert got == brute(subs.collect(), rows.collect())


def test_every_claim_and_unclaimed_row_once_in_any_order(spark, submissions, ledger):
    rng = random.Random(11)
    subs = submissions(*[
        dict(group_id=rng.choice([None, "gr1.a", "gr2.b", "gr3.c"]), sync_status=rng.choice(["SUCCESS", "FAILED"]))
        for _ in range(80)
    ])
    rows = ledger(*[("a", f"gr{rng.randint(1, 6)}.a", "2026-07-30") for _ in range(20)])
    first = run(spark, subs, rows)
    again = run(spark, subs.orderBy(F.rand(5)).repartition(7), rows.orderBy(F.rand(6)).repartition(3))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert first.where("evidence_id is not null").count() == 80
    assert first.where("evidence_id is null").select("row_id").distinct().count() == first.where("evidence_id is null").count()


def test_hot_key_gives_one_conform_and_the_rest_repeats(spark, submissions, ledger):
    subs = submissions(*[dict() for _ in range(500)], dict(group_id="gr2.b"))
    out = statuses(run(spark, subs, ledger(*[("a", "gr1.a", "2026-07-30")] * 300)))
    assert (out["CONFORME"], out["DOUBLON_WHATSAPP"]) == (1, 499)
