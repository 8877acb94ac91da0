"""What streams keep in tables: no key is forgotten, a batch reads little however long the stream has run, a repeated batch changes nothing."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.operators import cases as C
from proofline.operators import windows
from proofline.streaming import feed
from proofline.streaming.days import NO_DAY, DayTable, day_of, days_of
from proofline.streaming.keylog import KeyLog, filter_of, may_hold

NOW = "2026-07-31 12:00:00"
CASE = ("case_evidence_id bigint, status string, replacement_evidence_id bigint, created_at timestamp_ntz, "
        "reason string, resolved_at timestamp_ntz")
MESSAGE = "evidence_id bigint, message_id string, message_date timestamp_ntz"


def test_filters_miss_nothing_and_pass_little():
    rng = np.random.default_rng(1)
    held, others = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    packed = filter_of(held)
    assert may_hold(packed, held).all() and may_hold(packed, others).mean() < 0.03
    assert len(packed) <= 5000 * 10 / 8 + 8


def rows_in(spark, paths):
    return sum(spark.read.parquet(p).count() for p in paths)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "k string")


def test_key_log_finds_every_key_of_every_earlier_batch(spark, tmp_path):
    log = KeyLog(spark, str(tmp_path), "k", ["v"], rows=20, fan=2)
    rng, known = random.Random(4), {}
    for batch in range(5):
        fresh = {f"key{rng.randrange(10**6)}-{batch}-{i}": batch * 100 + i for i in range(30)}
        asked = keys(spark, *rng.sample(sorted(known), min(len(known), 5)), "never", *list(fresh)[:2])
        got = {r["k"]: r["v"] for r in log.earlier(asked, batch).collect()}
        assert got == {k: v for k, v in known.items() if k in {r["k"] for r in asked.collect()}}
        log.add(spark.createDataFrame(list(fresh.items()), "k string, v bigint"), batch)
        known |= fresh
    # two runs of two batches have become one of four
    assert [(r.first, r.last) for r in log.before(5)] == [(0, 3), (4, 4)]
    assert log.earlier(keys(spark, *known), 5).count() == len(known)
    assert log.earlier(keys(spark, *known), 0).count() == 0
    assert log.earlier(keys(spark), 5).count() == 0


def test_key_log_with_missing_keys_and_a_repeated_batch(spark, tmp_path):
    log = KeyLog(spark, str(tmp_path), "k", rows=5, fan=2)
    log.add(keys(spark, "a", None), 0)
    for _ in range(2):  # the second time the batch is repeated, its run and the merged one are there already
        assert sorted(map(str, (r["k"] for r in log.earlier(keys(spark, None, "a", "b"), 1).collect()))) == ["None", "a"]
        log.add(keys(spark, "b"), 1)
    assert sorted(map(str, (r["k"] for r in log.earlier(keys(spark, None, "a", "b", "c"), 2).collect()))) == ["None", "a", "b"]


def test_buckets_read_by_a_batch_stay_level(spark, tmp_path):
    log = KeyLog(spark, str(tmp_path), "k", rows=25, fan=4)
    read = []
    for batch in range(12):
        own = keys(spark, *[f"m{batch}-{i}" for i in range(100)])
        repeats = keys(spark, *([f"m{batch // 3}-{i}" for i in range(2)] if batch else []))
        paths = log.touched(own.unionByName(repeats), batch)
        read.append(rows_in(spark, paths))
        log.add(own, batch)
    # twelve batches hold 1200 keys; a batch reads the buckets of its two repeats and of the few keys that pass a filter by chance
    assert max(read[6:]) <= 400 and sum(read[9:]) <= 1.5 * sum(read[4:7]) + 300


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_dedup_over_twenty_batches_catches_late_repeats(spark, tmp_path):
    day = dt.datetime(2026, 7, 1)
    rows = [(i, f"m{i}", day + dt.timedelta(hours=i)) for i in range(200)]
    rows += [(500 + i, f"m{i * 9}", day + dt.timedelta(hours=i * 9)) for i in range(20)]  # repeats, most of them late
    rows += [(600, None, day), (601, None, day)]
    df = spark.createDataFrame(rows, MESSAGE)
    batch = F.when(F.col("evidence_id") < 200, F.floor(F.col("evidence_id") / 10)).otherwise(F.col("evidence_id") % 20)
    for number in range(20):
        df.where(batch == number).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "state")
    feed.run_available(stream_of(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "c"), feed.dedup_sink(root, rows=20, fan=4))
    got = [r["message_id"] for r in feed.read_batches(spark, f"{root}/new").collect()]
    assert len(got) == 201 and set(got) == {None, *[f"m{i}" for i in range(200)]}
    state = [p for p in (tmp_path / "c").rglob("*") if p.is_dir() and p.name == "state"]
    assert not any(list(p.rglob("*.delta")) or list(p.rglob("*.snapshot")) or list(p.rglob("*.zip")) for p in state)


def test_dedup_keeps_the_first_of_a_batch_and_repeats_alike(spark, tmp_path):
    sink = feed.dedup_sink(str(tmp_path))
    day = dt.datetime(2026, 7, 1)
    first = spark.createDataFrame([(2, "a", day), (1, "a", day), (3, "b", None)], MESSAGE)
    for _ in range(2):
        sink(first, 0)
    sink(spark.createDataFrame([(4, "b", day), (5, "c", day)], MESSAGE), 1)
    sink(first.limit(0), 2)
    got = sorted((r["evidence_id"], r["message_id"]) for r in feed.read_batches(spark, f"{tmp_path}/new").collect())
    assert got == [(1, "a"), (3, "b"), (5, "c")]


def test_content_dedup_over_many_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), rng.choice([f"h{rng.randrange(25)}", f"u{i}", None])) for i in range(60)]
    files = spark.createDataFrame(rows, "evidence_id bigint, received_at timestamp_ntz, sha256 string")
    sink = feed.content_dedup_sink(str(tmp_path), rows=10, fan=3)
    for number in range(6):
        part = files.where(F.floor(F.col("evidence_id") / 10) == number)
        for _ in range(2 if number in (2, 5) else 1):  # the batches whose runs are merged are repeated
            sink(part, number)
    got = {r["evidence_id"]: r["duplicate_of_id"] for r in feed.read_batches(spark, f"{tmp_path}/files").collect()}
    twin = {r["evidence_id"]: r["duplicate_of_id"] for r in windows.content_dedup(files, "sha256").collect()}
    assert got == twin and len(got) == 60


def test_days(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-07-01"), (2, "2026-07-02"), (3, "soon"), (4, None)], "id bigint, at string").withColumn("day", day_of(F.col("at")))
    assert days_of((rows, "day")) == ["2026-07-01", "2026-07-02", NO_DAY]
    table = DayTable(spark, str(tmp_path / "t"), rows.schema.fields, "day")
    assert table.days(["2026-07-01"], 9).count() == 0
    for _ in range(2):
        table.put(rows, 0)
    table.put(rows.where("id = 1"), 1)
    assert sorted((r["id"], r["batch"]) for r in table.days(["2026-07-01", NO_DAY], 2).collect()) == [(1, 0), (1, 1), (3, 0), (4, 0)]
    assert table.days(["2026-07-01"], 1).count() == 1


def final_cases(spark, root):
    newest = feed.latest_rows(feed.read_batches(spark, f"{root}/cases"), ["case_evidence_id"])
    return sorted((r["case_evidence_id"], r["status"], r["replacement_evidence_id"], r["reason"]) for r in newest.collect())


def twin_cases(prior, subs):
    rows = C.rebuild_cases(prior, subs, NOW).collect()
    return sorted((r["case_evidence_id"], r["status"], r["replacement_evidence_id"], r["reason"]) for r in rows)


def test_rows_that_a_batch_of_cases_reads_stay_level(spark, tmp_path, submissions, monkeypatch):
    rng = random.Random(2)
    rows = [dict(
        received_at=dt.datetime(2026, 7, 1, 8) + dt.timedelta(days=i // 12, minutes=i % 12), sync_date=str(dt.date(2026, 7, 1) + dt.timedelta(days=i // 12)),
        group_id=rng.choice(["gr1.a", "gr2.b", None]), sync_status=rng.choice(["SUCCESS", "FAILED", "FAILED"]),
    ) for i in range(96)]
    subs = submissions(*rows)
    prior = spark.createDataFrame([], CASE)
    read, plain = [], DayTable.days

    def counted(self, wanted, before):
        found = plain(self, wanted, before)
        read[-1] += found.count()
        return found

    monkeypatch.setattr(DayTable, "days", counted)
    sink = feed.case_state_sink(str(tmp_path), prior, NOW)
    for number in range(8):
        read.append(0)
        sink(subs.where(F.floor((F.col("evidence_id") - 1) / 12) == number), number)
    assert max(read[1:]) <= 1.5 * read[1] + 20  # the last batch reads no more than the second
    assert final_cases(spark, str(tmp_path)) == twin_cases(prior, subs)


def test_a_submission_that_moves_to_another_report_leaves_the_old_one(spark, tmp_path, submissions):
    sink = feed.case_state_sink(str(tmp_path), spark.createDataFrame([], CASE), NOW)
    bad = dict(sync_status="FAILED", group_id="gr1.a")
    sink(submissions(dict(bad, evidence_id=1), dict(bad, evidence_id=2, group_id="gr2.b")), 0)
    assert [r[:3] for r in final_cases(spark, str(tmp_path))] == [(1, "OPEN", None), (2, "OPEN", None)]
    fits = dict(evidence_id=3, received_at=dt.datetime(2026, 7, 30, 9), group_id="gr1.a")
    sink(submissions(fits), 1)
    assert [r[:3] for r in final_cases(spark, str(tmp_path))] == [(1, "RESOLVED", 3), (2, "OPEN", None)]
    # corrected to the other group: the second case closes; the first stays with its replacement, which is still usable
    sink(submissions(dict(fits, group_id="gr2.b")), 2)
    assert [r[:3] for r in final_cases(spark, str(tmp_path))] == [(1, "RESOLVED", 3), (2, "RESOLVED", 3)]
    # no longer usable: both open again, wherever their reports are
    for _ in range(2):
        sink(submissions(dict(fits, group_id="gr2.b", sync_status="FAILED")), 3)
    assert [r[:3] for r in final_cases(spark, str(tmp_path))] == [(1, "OPEN", None), (2, "OPEN", None), (3, "OPEN", None)]


def test_cases_from_before_the_stream_follow_replacements_elsewhere(spark, tmp_path, submissions):
    prior = spark.createDataFrame([
        (1, "RESOLVED", 9, dt.datetime(2026, 7, 1), "m", None), (2, "RESOLVED", 8, dt.datetime(2026, 7, 1), "m", None), (5, "WAITING", None, dt.datetime(2026, 7, 1), "m", None),
    ], CASE)
    rows = [dict(evidence_id=1, sync_status="FAILED"), dict(evidence_id=2, sync_status="FAILED", group_id="gr2.b", date_is_ambiguous=True), dict(evidence_id=5, sync_status="FAILED", group_id=None),
            dict(evidence_id=9, sync_status="FAILED", group_id="gr9.z"), dict(evidence_id=8, group_id="gr9.y")]
    subs = submissions(*rows)
    for order in ([1, 9, 2, 8, 5],):
        root = str(tmp_path / "-".join(map(str, order)))
        sink = feed.case_state_sink(root, prior, NOW)
        for number, one in enumerate(order):
            sink(subs.where(F.col("evidence_id") == one), number)
        assert final_cases(spark, root) == twin_cases(prior, subs)


@pytest.mark.parametrize("parts", [3])
def test_an_empty_batch_and_any_order(spark, tmp_path, submissions, parts):
    rng = random.Random(parts)
    subs = submissions(*[dict(
        group_id=rng.choice(["gr1.a", "gr2.b", None]), sync_status=rng.choice(["SUCCESS", "FAILED"]), sync_date=rng.choice(["2026-07-30", "2026-07-29", None]),
        received_at=dt.datetime(2026, 7, rng.randint(28, 31), rng.randint(0, 23)), processing_status=rng.choice(["COMPLETED", "FAILED", "PENDING"]),
    ) for _ in range(50)])
    prior = spark.createDataFrame([(5, "RESOLVED", 6, dt.datetime(2026, 7, 1), "m", None)], CASE)
    sink = feed.case_state_sink(str(tmp_path), prior, NOW)
    sink(subs.limit(0), 0)
    for number in range(parts):
        sink(subs.where(F.pmod(F.xxhash64("evidence_id"), F.lit(parts)) == number), number + 1)
    assert [r[:2] for r in final_cases(spark, str(tmp_path))] == [r[:2] for r in twin_cases(prior, subs)]
