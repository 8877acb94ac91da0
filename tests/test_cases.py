import datetime as dt
import random

import pytest

from proofline.operators import cases as C
from proofline.operators import identity, reminders
from proofline.operators.timeline import asof_forward_match

NOW = "2026-07-31 12:00:00"
CASE = ("case_evidence_id bigint, status string, replacement_evidence_id bigint, created_at timestamp_ntz, "
        "reason string, resolved_at timestamp_ntz")
ATTEMPT = ("attempt_id bigint, case_evidence_id bigint, recipient string, created_at timestamp_ntz, body string, "
           "status string, external_message_id string")
BAD = dict(sync_status="UNCONFIRMED")


def at(hour, minute=0, day=30):
    return dt.datetime(2026, 7, day, hour, minute)


def no_cases(spark):
    return spark.createDataFrame([], CASE)


def by_id(df):
    return {r["case_evidence_id"]: r for r in df.collect()}


@pytest.mark.parametrize("change", [
    dict(application_id="b"), dict(application_id=None), dict(group_id="gr2.b"), dict(sync_date="2026-07-29"),
    dict(date_is_ambiguous=True), dict(sender_identity="other"), dict(received_at=at(7)), dict(sync_status="FAILED"),
    dict(duplicate_of_id=9),
])
def test_each_broken_guard_prevents_a_match(spark, submissions, change):
    good = submissions(dict(received_at=at(8), **BAD), dict(received_at=at(9)))
    bad = submissions(dict(received_at=at(8), **BAD), {**dict(received_at=at(9)), **change})
    pairs = spark.createDataFrame([(1, 2)], "evidence_id bigint, replacement_id bigint")
    assert C.match_guards(pairs, good).first()["ok"]
    assert not C.match_guards(pairs, bad).first()["ok"]
    assert by_id(C.rebuild_cases(no_cases(spark), good, NOW))[1]["replacement_evidence_id"] == 2
    assert by_id(C.rebuild_cases(no_cases(spark), bad, NOW))[1]["status"] == "OPEN"


def test_manual_link_allows_unknown_facts_but_no_contradiction(spark, submissions):
    subs = submissions(
        dict(group_id=None, sync_date=None, application_id=None, received_at=at(8), **BAD), dict(received_at=at(9)),
        dict(group_id="gr2.b", received_at=at(8), **BAD),
    )
    pairs = spark.createDataFrame([(1, 2), (3, 2), (2, 1)], "evidence_id bigint, replacement_id bigint")
    assert {tuple(r)[:2]: r["ok"] for r in C.manual_link_check(pairs, subs).collect()} == {
        (1, 2): True, (3, 2): False, (2, 1): False
    }


def test_rebuild_opens_closes_reopens_and_repeats(spark, submissions):
    subs = submissions(
        dict(received_at=at(8), **BAD), dict(received_at=at(10)), dict(received_at=at(9)),  # 1 closed by 3
        dict(group_id="gr4.d", sync_status="FAILED"),  # 4 stays open
        dict(group_id="gr5.e"), dict(group_id="gr6.f", sync_status="FAILED"),  # 5 was a problem, is usable
        dict(group_id="gr7.g", processing_status="PENDING", **BAD), dict(group_id="gr8.h", **BAD),
    )
    prior = spark.createDataFrame([
        (5, "WAITING", None, at(6), "ancien", None), (6, "RESOLVED", 4, at(6), "ancien", at(7)),
        (8, "RESOLVED", 7, at(6), "ancien", at(7)),
    ], CASE)
    out = C.rebuild_cases(prior, subs, NOW)
    rows = by_id(out)
    assert (rows[1]["status"], rows[1]["replacement_evidence_id"]) == ("RESOLVED", 3)
    assert rows[4]["status"] == "OPEN" and "Synchronisation échouée" in rows[4]["reason"]
    assert (rows[5]["status"], rows[5]["replacement_evidence_id"]) == ("RESOLVED", 5)
    assert (rows[6]["status"], rows[6]["resolved_at"]) == ("OPEN", None)  # its replacement is not usable
    assert (rows[8]["status"], rows[8]["replacement_evidence_id"]) == ("RESOLVED", 7)  # being processed again
    assert set(rows) == {1, 4, 5, 6, 8}
    again = C.rebuild_cases(out, subs, NOW)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_asof_equals_brute_force_across_slots_and_ties(spark, submissions):
    rng = random.Random(5)
    rows = [
        dict(received_at=at(8) + dt.timedelta(minutes=rng.choice([0, 1, 1, 30, 61, 500]), seconds=rng.choice([0, 5, 59])),
             group_id=f"gr{rng.randint(1, 3)}.x", sync_status=rng.choice(["SUCCESS", "FAILED"])) for _ in range(150)
    ]
    subs = submissions(*rows)
    facts = subs.collect()
    good = [r for r in facts if r["sync_status"] == "SUCCESS"]
    expected = {}
    for o in facts:
        if o["sync_status"] == "SUCCESS":
            continue
        later = [g for g in good if g["group_id"] == o["group_id"] and g["received_at"] >= o["received_at"]]
        if later:
            expected[o["evidence_id"]] = min(later, key=lambda g: (g["received_at"], g["evidence_id"]))["evidence_id"]
    for slot in ("minute", "hour", "day"):
        out = asof_forward_match(
            subs.where("sync_status = 'FAILED'"), subs.where("sync_status = 'SUCCESS'"), identity.KEY, slot=slot
        )
        assert {r["evidence_id"]: r["replacement_id"] for r in out.collect()} == expected


def attempts(spark, *rows):
    return spark.createDataFrame([
        (i, case, "70000001@c.us", when, "b", status, None) for i, (case, when, status) in enumerate(rows, 1)
    ], ATTEMPT)


def cases_for(spark, *ids, status="OPEN"):
    return spark.createDataFrame([(i, status, None, at(6), "motif", None) for i in ids], CASE)


def test_groups_share_a_report_and_returns_need_the_first_reminder(spark, submissions):
    subs = submissions(
        dict(received_at=at(8), **BAD), dict(received_at=at(9), **BAD), dict(received_at=at(12), **BAD),
        dict(received_at=at(13), duplicate_of_id=1, processing_status="DUPLICATE"),
        dict(group_id=None, **BAD),
    )
    rows = by_id(C.followup_rows(
        cases_for(spark, 1, 2, 5), subs, attempts(spark, (2, at(10), "SENT"), (1, at(11), "UNKNOWN"))
    ))
    assert set(rows) == {1, 5}
    lead = rows[1]
    assert (lead["case_count"], lead["returned_count"], lead["status"]) == (2, 1, "RETURNED_INVALID")
    assert (lead["attempt_count"], lead["last_send_status"], lead["uncertain_send"]) == (2, "UNKNOWN", True)
    assert rows[5]["status"] == "OPEN"


def agents(spark):
    return spark.createDataFrame([(7, "70000009"), (8, "none")], "agent_id bigint, phone string")


def applications(spark):
    return spark.createDataFrame([("a", "Suivi A")], "application_id string, name string")


def test_agent_phone_stands_in_for_a_missing_one(spark, submissions):
    subs = submissions(
        dict(sender_phone=None, agent_id=7), dict(sender_phone="", agent_id=7), dict(sender_phone="x", agent_id=7),
        dict(sender_phone=None, agent_id=8), dict(sender_phone=None), dict(sender_phone=None, agent_id=7, sender_external_id="99@lid"),
    )
    got = {r["evidence_id"]: r["recipient"] for r in C.with_recipient(subs, agents(spark)).collect()}
    assert got == {1: "70000009@c.us", 2: "70000009@c.us", 3: None, 4: None, 5: None, 6: "99@lid"}


def test_reminder_candidates_and_drafts(spark, submissions):
    subs = submissions(dict(**BAD), dict(**BAD), dict(group_id="gr2.b", **BAD), dict(group_id="gr3.c", sender_phone="x", **BAD),
                       dict(group_id="gr4.d", **BAD))
    cases = cases_for(spark, 1, 2, 3, 4).unionByName(cases_for(spark, 5, status="RESOLVED"))
    sent = attempts(spark, (3, at(10), "UNKNOWN"))
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 99)], "case_evidence_id bigint")
    out = by_id(reminders.reminder_candidates(ids, cases, subs, sent, agents(spark), NOW))
    assert {k: r["outcome"] for k, r in out.items()} == {
        1: "ready", 3: "blocked", 4: "no_recipient", 5: "closed", 99: "closed"
    }
    drafts = reminders.prepare_drafts(cases, subs, sent, agents(spark), applications(spark), NOW).collect()
    assert [r["case_evidence_id"] for r in drafts] == [1] and "Référence de suivi : 1." in drafts[0]["body"]


def test_digest_one_message_per_recipient_and_uncertain_is_never_retried(spark, submissions):
    subs = submissions(dict(**BAD), dict(group_id="gr2.b", **BAD), dict(group_id="gr3.c", sender_phone="70000002", **BAD),
                       dict(received_at=at(8, day=29), **BAD))
    cases = cases_for(spark, 1, 2, 3, 4)
    campaigns = spark.createDataFrame([], "day string, recipient string, status string")
    sent = spark.createDataFrame([(1, 3, "70000002@c.us", at(8, day=1), "b", "UNKNOWN", None)], ATTEMPT)
    rows = {r["recipient"]: r for r in reminders.reminder_digest(cases, subs, sent, campaigns, agents(spark), applications(spark), "2026-07-30").collect()}
    assert rows["70000001@c.us"]["outcome"] == "prepared" and rows["70000001@c.us"]["entries"] == 2
    body = rows["70000001@c.us"]["body"]
    assert "1. Suivi A / gr1.a : motif. Réf. 1\n2. Suivi A / gr2.b" in body
    assert len(body) == rows["70000001@c.us"]["body_length"]
    assert rows["70000002@c.us"]["outcome"] == "skipped_sent_or_uncertain"
    early = reminders.daily_digest(cases, subs, sent, campaigns, agents(spark), applications(spark), dt.datetime(2026, 7, 30, 21, 59))
    assert early.count() == 0


def test_digest_too_long_is_skipped_whole(spark, submissions):
    subs = submissions(*[dict(group_id=f"gr{i}.x", **BAD) for i in range(120)])
    campaigns = spark.createDataFrame([], "day string, recipient string, status string")
    row = reminders.reminder_digest(
        cases_for(spark, *range(1, 121)), subs, attempts(spark), campaigns, agents(spark), applications(spark), "2026-07-30"
    ).first()
    assert (row["outcome"], row["body"], row["entries"]) == ("skipped_too_long", None, 120)
    full = reminders.reminder_digest(
        cases_for(spark, *range(1, 121)), subs, attempts(spark), campaigns, agents(spark), applications(spark), "2026-07-30", max_chars=10**6
    ).first()
    assert len(full["body"]) == full["body_length"] == row["body_length"]


def test_send_stats_and_history_period(spark, submissions):
    subs = submissions(dict(**BAD))
    sent = attempts(spark, (1, at(10, day=28), "SENT"), (1, at(13, day=29), "MANUALLY_CONFIRMED"), (1, at(9), "UNKNOWN"))
    row = C.case_send_stats(cases_for(spark, 1), subs, sent, NOW).first()
    assert (row["sent_count"], row["days_since_reminder"]) == (2, 1)
    assert C.case_history_join(sent, cases_for(spark, 1), subs, "day", "2026-07-29").count() == 1
    assert C.case_history_join(sent, cases_for(spark, 1), subs, "week", "2026-07-30").count() == 3
