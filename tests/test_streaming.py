"""Streams give what their batch twins give, over several micro-batches and restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from proofline.operators import cases as C
from proofline.operators import windows
from proofline.sources import readers
from proofline.streaming import feed

NOW = "2026-07-31 12:00:00"
CASE = ("case_evidence_id bigint, status string, replacement_evidence_id bigint, created_at timestamp_ntz, "
        "reason string, resolved_at timestamp_ntz")
MESSAGE = ("message_id string, channel_id bigint, message_date timestamp, evidence_id bigint, download_status string, "
           "storage_path string, retry_count int")


def feed_files(df, path, batches, order):
    """One file per micro-batch, in order."""
    for number in range(batches):
        df.where(F.col(order) % batches == number).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def messages(spark, *rows):
    return spark.createDataFrame([
        (m, c, dt.datetime(2026, 7, 30, 8) + dt.timedelta(hours=h), e, s, p, n) for m, c, h, e, s, p, n in rows
    ], MESSAGE)


def test_each_message_once_across_batches(spark, tmp_path):
    rows = messages(spark, *[(f"m{i % 7}", 1, i % 3, i, "DOWNLOADED", "x", 0) for i in range(30)])
    feed_files(rows, str(tmp_path / "in"), 3, "evidence_id")
    out = feed.stream_dedup(stream(spark, str(tmp_path / "in"), rows.schema))
    feed.run_available(out, str(tmp_path / "c"), str(tmp_path / "out"))
    got = [r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("message_id").collect()]
    assert sorted(got) == [f"m{i}" for i in range(7)]


def test_first_routing_rule_wins(spark):
    rows = messages(
        spark, ("m1", 1, -24, 1, "FAILED", None, 0), ("m2", 1, 1, 2, "FAILED", None, 0), ("m3", 2, 1, 3, "DOWNLOADED", None, 0),
        ("m4", 9, 1, 4, "DOWNLOADED", "x", 0), ("m5", 1, 1, 5, "DOWNLOADED", None, 0), ("m6", 1, 1, 6, "DOWNLOADED", "x", 0),
        ("m7", 1, 1, 7, "DOWNLOADED", "gone", 0),
    )
    channels = spark.createDataFrame([(1, True), (2, False)], "channel_id bigint, is_monitored boolean")
    routed = feed.stream_route(rows, channels, "2026-07-30 00:00:00")
    got = {r["message_id"]: r["route"] for r in routed.collect()}
    assert got == {"m1": "SKIPPED_NO_MEDIA", "m2": "FAILED", "m3": "SKIPPED_UNAUTHORIZED_GROUP",
                   "m4": "SKIPPED_UNAUTHORIZED_GROUP", "m5": "FAILED", "m6": "ACCEPTED", "m7": "ACCEPTED"}
    manifest = spark.createDataFrame([("x",)], "path string")
    listed = feed.stream_route(rows, channels, "2026-07-30 00:00:00", manifest)
    assert {r["message_id"]: r["route"] for r in listed.collect()}["m7"] == "FAILED"


def test_content_dedup_over_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), rng.choice("abcdefgh")) for i in range(60)]
    files = spark.createDataFrame(rows, "evidence_id bigint, received_at timestamp_ntz, sha256 string")
    for number in range(3):  # arrival order is time order
        files.where(F.floor(F.col("evidence_id") / 20) == number).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "state")
    feed.run_available(stream(spark, str(tmp_path / "in"), files.schema), str(tmp_path / "c"), feed.content_dedup_sink(root))
    got = {r["evidence_id"]: r["duplicate_of_id"] for r in feed.read_batches(spark, f"{root}/files").collect()}
    twin = {r["evidence_id"]: r["duplicate_of_id"] for r in windows.content_dedup(files, "sha256").collect()}
    assert got == twin and len(got) == 60


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    files = spark.createDataFrame([(1, 1, "a"), (2, 2, "a")], "evidence_id bigint, received_at int, sha256 string")
    sink = feed.content_dedup_sink(str(tmp_path))
    sink(files, 0)
    sink(files, 0)
    assert feed.read_batches(spark, f"{tmp_path}/files").count() == 2


def test_case_state_is_right_for_any_order_of_arrival(spark, tmp_path, submissions):
    rng = random.Random(9)
    rows = [
        dict(group_id=rng.choice(["gr1.a", "gr2.b", "gr3.c", None]), sync_status=rng.choice(["SUCCESS", "FAILED"]),
             processing_status=rng.choice(["COMPLETED", "COMPLETED", "FAILED"])) for _ in range(60)
    ]
    subs = submissions(*rows)
    prior = spark.createDataFrame([(5, "RESOLVED", 6, dt.datetime(2026, 7, 1), "m", None)], CASE)
    shuffled = subs.withColumn("arrival", F.pmod(F.xxhash64("evidence_id"), F.lit(4)))
    for number in range(4):
        shuffled.where(F.col("arrival") == number).drop("arrival").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "state")
    feed.run_available(
        stream(spark, str(tmp_path / "in"), subs.schema), str(tmp_path / "c"), feed.case_state_sink(root, prior, NOW)
    )
    got = feed.latest_rows(feed.read_batches(spark, f"{root}/cases"), ["case_evidence_id"])
    twin = C.rebuild_cases(prior, subs, NOW)
    keep = ["case_evidence_id", "status"]
    assert sorted(map(tuple, got.select(keep).collect())) == sorted(map(tuple, twin.select(keep).collect()))
    # A replacement may be an earlier processed match, but is always an acceptable one.
    pairs = got.where("status = 'RESOLVED' AND replacement_evidence_id <> case_evidence_id").select(
        F.col("case_evidence_id").alias("evidence_id"), F.col("replacement_evidence_id").alias("replacement_id")
    ).where("evidence_id <> 5")
    assert C.match_guards(pairs, subs).where("NOT ok").count() == 0


GATEWAY = "event_id int, gateway_id string, at_time timestamp_ntz, connection_state string"


def gateway_run(spark, root, *batches):
    sink = feed.gateway_sink(root)
    for number, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, GATEWAY), number)
    return sorted((r["event_id"], r["previous_state"]) for r in feed.gateway_changes(spark, root).collect())


def test_gateway_changes_across_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("gh"), dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(90)), rng.choice(["A", "B", "C", None])) for i in range(80)]
    events = spark.createDataFrame(rows, GATEWAY)
    feed_files(events, str(tmp_path / "in"), 4, "event_id")  # out of order in time
    root = str(tmp_path / "state")
    feed.run_available(stream(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "c"), feed.gateway_sink(root))
    got = sorted((r["event_id"], r["previous_state"]) for r in feed.gateway_changes(spark, root).collect())
    assert got == sorted((r["event_id"], r["previous_state"]) for r in feed.gateway_transitions(events).collect())


def test_gateway_heartbeats_without_state_and_late_ones(spark, tmp_path):
    at_minute = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    nothing = gateway_run(spark, str(tmp_path / "a"), [(1, "g", at_minute(1), "A"), (2, "g", at_minute(2), None)],
                          [(3, "g", at_minute(3), "A"), (4, "g", at_minute(4), "B")])
    assert nothing == [(1, None), (4, "A")]
    late = gateway_run(spark, str(tmp_path / "b"), [(1, "g", at_minute(1), "A"), (5, "g", at_minute(5), "B")],
                       [(3, "g", at_minute(3), "A"), (6, "g", at_minute(6), "B")])
    assert late == [(1, None), (5, "A")]
    day = 1440
    over = gateway_run(spark, str(tmp_path / "c"), [(1, "g", at_minute(1), "A"), (9, "g", at_minute(9 * day), "B")],
                       [(5, "g", at_minute(5 * day), "B")])
    assert over == [(1, None), (5, "A")]


def test_versions_of_one_batch_are_told_apart(spark):
    rows = spark.createDataFrame(
        [(1, 0, 5, "PENDING"), (1, 0, 6, "COMPLETED"), (2, 0, 9, "NEW"), (2, 1, 1, "OLD")], "id int, batch int, changed int, status string"
    )
    for order in (rows, rows.orderBy("status"), rows.orderBy(F.desc("status"))):
        assert {r["id"]: r["status"] for r in feed.latest_rows(order, ["id"], ["changed"]).collect()} == {1: "COMPLETED", 2: "OLD"}


def test_window_counts_update_across_batches(spark, tmp_path):
    rows = messages(spark, *[(f"m{i}", i % 2, i, i, "DOWNLOADED" if i % 3 else "FAILED", "x", 0) for i in range(40)])
    feed_files(rows, str(tmp_path / "in"), 3, "evidence_id")
    out = feed.tumbling_counts(stream(spark, str(tmp_path / "in"), rows.schema))
    feed.run_available(out, str(tmp_path / "c"), feed.upsert_sink(str(tmp_path / "out")), "update")
    got = feed.latest_rows(feed.read_batches(spark, str(tmp_path / "out")), ["day", "channel_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, feed.tumbling_counts(rows).collect()))


def test_files_are_listed_once_across_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"1")
    for _ in range(2):
        feed.run_available(readers.incremental_files(spark, str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "out"))
    (tmp_path / "in" / "b.mp4").write_bytes(b"12")
    feed.run_available(readers.incremental_files(spark, str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "out"))
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.jpg", "b.mp4"]


def test_new_channels_and_retries(spark):
    rows = messages(spark, ("m1", 1, 1, 1, "FAILED", None, 4), ("m2", 5, 2, None, "FAILED", None, 0), ("m3", 5, 3, 3, "FAILED", None, 5))
    known = spark.createDataFrame([(1,)], "channel_id bigint")
    assert {r["channel_id"]: r["is_new"] for r in feed.discover_channels(rows, known).collect()} == {1: False, 5: True}
    retried, spent = feed.retry_budget(rows)
    assert {r["message_id"]: (r["retry_count"], r["download_status"]) for r in retried.collect()} == {
        "m1": (5, "DOWNLOADED"), "m2": (1, "FAILED")
    }
    assert [r["message_id"] for r in spent.collect()] == ["m3"]
