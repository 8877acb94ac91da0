"""Imports, matching, windows, reviews, frames, retention, sources and sinks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from proofline.functions import similarity
from proofline.functions.similarity import ratio
from proofline.operators import frames, imports, listing, matching, reviews, stats, windows
from proofline.session import scratch
from proofline.sources import readers, sinks


def test_ledger_import_keeps_invalid_rows(spark):
    rows = spark.createDataFrame([
        (2, "gr1.tanga", "2026-07-30", "A"), (3, "gr1.tanga", "30/07/2026", "B"), (4, "", "2026-07-30", "C"),
        (5, "gr2.zone", "jamais", "D"), (6, "gr3.nord", "2026-07-29", "E"),
    ], "row_number bigint, `GR plateforme` string, `Date synchro` string, Agent string")
    done, totals = imports.import_ledger(rows, {"group_id": "GR plateforme", "sync_date": "Date synchro", "agent": "Agent"})
    assert totals.first().asDict() == dict(total_rows=5, imported_rows=3, rejected_rows=2, duplicate_rows=1)
    assert done.count() == 5
    assert [r["row_number"] for r in imports.error_report(done).collect()] == [4, 5]
    with pytest.raises(ValueError):
        imports.import_ledger(rows, {"sync_date": "Date synchro"})


def test_expected_ids_are_added_once(spark):
    ids = spark.createDataFrame([("ID",), (" GR1.A ",), ("gr1.a",), ("gr2.b",), ("",), (None,)], "v string")
    known = spark.createDataFrame([(1, "a", "gr2.b"), (2, "a", "gr1.a")], "project_id int, application_id string, business_id string")
    added, present = imports.import_expected(ids, known, 1, "a")
    assert [r[0] for r in added.collect()] == ["gr1.a"] and [r[0] for r in present.collect()] == ["gr2.b"]
    stored = known.unionByName(added.select(F.lit(1).alias("project_id"), F.lit("a").alias("application_id"), "business_id"))
    assert imports.import_expected(ids, stored, 1, "a")[0].count() == 0


def test_agent_columns_by_header_words(spark):
    rows = spark.createDataFrame([(2, " Awa ", "70"), (3, " ", "71"), (4, None, "72")], "row_number int, `Nom Agent` string, Telephone string")
    valid, rejects = imports.import_agents(rows)
    assert [(r["full_name"], r["phone"]) for r in valid.collect()] == [("Awa", "70")]
    assert [r["error"] for r in rejects.collect()] == ["Ligne 3: nom manquant", "Ligne 4: nom manquant"]


def plain_levenshtein(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            previous, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, previous + (x != y))
    return line[-1]


@pytest.mark.parametrize("cut", [60, 83])
def test_similar_pairs_equal_brute_force(spark, cut):
    rng = random.Random(cut)

    def word():
        return "".join(rng.choice("ab1.-") for _ in range(rng.randint(1, 12)))

    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)})
    right += [left[0] + "x", left[1][1:]]
    long = "".join(rng.choice("abcdefgh") for _ in range(90))  # too long for its forms, found by pieces
    left.append(long)
    right += [long[:40] + "Z" + long[41:], long[5:], "".join(rng.sample(long, 90))]
    got = matching.similar_pairs(
        spark.createDataFrame([(w,) for w in left], "id string"), spark.createDataFrame([(w,) for w in right], "k string"), cut
    ).collect()
    expected = {
        (a, b) for a in left for b in right if b
        and 100 * (1 - plain_levenshtein(a, b) / max(len(a), len(b))) >= cut - 1e-9
    }
    assert {(r["id"], r["known"]) for r in got} == expected and len(got) == len(expected)


def test_indel_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    left = sorted({"".join(rng.choice("ab1.") for _ in range(rng.randint(1, 12))) for _ in range(80)})
    right = sorted({"".join(rng.choice("ab1.") for _ in range(rng.randint(1, 12))) for _ in range(80)})
    got = matching.similar_pairs(
        spark.createDataFrame([(w,) for w in left], "id string"), spark.createDataFrame([(w,) for w in right], "k string"), 75, "indel"
    ).collect()
    assert {(r["id"], r["known"]) for r in got} == {(a, b) for a in left for b in right if ratio(a, b) >= 75 - 1e-9}


def test_candidates_of_an_id_do_not_grow_with_the_ids(spark):
    def met(n):
        ids = spark.range(n).select(F.concat(F.lit("gr"), F.md5(F.col("id").cast("string")).substr(1, 10), F.lit(".zone-n")).alias("text"))
        other = spark.range(n).select(F.concat(F.lit("gr"), F.md5((F.col("id") + 10**9).cast("string")).substr(1, 10), F.lit(".zone-n")).alias("text"))
        mine, theirs = (matching._forms(x, False) for x in (ids, other.unionByName(ids.limit(n // 10))))
        return matching._by_grams(mine, theirs, 88, "levenshtein").distinct().count() / n

    small, large = met(1000), met(8000)
    assert small < 0.3 and large < 0.3  # a pair for each planted copy, and few others


@pytest.mark.parametrize("cut,metric", [(88, "levenshtein"), (65, "levenshtein"), (83, "weighted")])
def test_an_id_has_at_most_two_rows_for_a_letter(spark, cut, metric):
    ids = spark.createDataFrame([(f"gr{i}.zone-{'abcdefgh'[i % 8]}uest-{i * 7919 % 1000}",) for i in range(300)], "text string")
    forms = matching._forms(ids, metric == "weighted")
    rows = matching._grams(forms, matching._gram_size(cut, "levenshtein" if metric == "levenshtein" else "indel"), True)
    if metric == "weighted":
        rows = rows.unionByName(matching._grams(forms, 2, False))
    letters = ids.agg(F.sum(F.length("text"))).first()[0]
    assert rows.count() <= 2 * letters


def plain_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        fresh = [0]
        for j, y in enumerate(b):
            fresh.append(line[j] + 1 if x == y else max(line[j + 1], fresh[j]))
        line = fresh
    return line[-1]


def plain_ratio(a, b):
    return 200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    ways = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
    return max(plain_ratio(s, t[max(i, 0) : i + len(s)]) for s, t in ways for i in range(1 - len(s), len(t)))


def plain_weighted(a, b):
    """The composite, written down once more for one pair."""
    if not a or not b:
        return 0.0
    x, y = sorted(a.split()), sorted(b.split())
    both, left, right = {*x} & {*y}, " ".join(sorted({*x} - {*y})), " ".join(sorted({*y} - {*x}))
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        words = 0.0
        if x and y:
            head = " ".join(both)
            gap = 1 if head else 0
            if both and not (left and right):
                words = 100.0
            else:
                total = 2 * (len(head) + gap) + len(left) + len(right)
                words = 100 - 100 * (len(left) + len(right) - 2 * plain_lcs(left, right)) / total
                if both:
                    words = max(words, *(100 - 100 * (1 + len(r)) / (2 * len(head) + 1 + len(r)) for r in (left, right)))
        return max(plain_ratio(a, b), 0.95 * max(plain_ratio(" ".join(x), " ".join(y)), words))
    scale = 0.9 if times <= 8 else 0.6
    stretch = 100.0 if both else max(plain_partial(" ".join(x), " ".join(y)), plain_partial(left, right))
    return max(plain_ratio(a, b), scale * plain_partial(a, b), 0.95 * scale * stretch)


@pytest.mark.parametrize("letters,longest", [("ab1.", 12), ("abcdefghij.-", 26), ("abcd ", 18), ("ab", 70)])
def test_weighted_scores_equal_plain_ones(letters, longest):
    rng = random.Random(longest)
    pairs = []
    for _ in range(250):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        pairs += [(a, b), (a, a[rng.randint(0, 3) : rng.randint(3, 30)] + b[:2]), (a + b, b + a)]
    got = similarity.weighted_ratios(*zip(*pairs))
    assert got.tolist() == pytest.approx([plain_weighted(a, b) for a, b in pairs])


@pytest.mark.parametrize("a,b,score", [
    # by ratio, by a stretch (0.9), by a short stretch (0.6), by words in another order (0.95), by a shared word (0.95 * 0.9)
    ("gr1.mil-ter", "gr1.mil-tar", 100 * 20 / 22), ("gr1.mil", "gr1.mil-ter-bagadou", 90.0), ("gr", "gr1.mil-ter-bagadou", 60.0),
    ("zone nord", "nord zone", 95.0), ("nord", "zone nord est", 90.0), ("nord x", "zone nord est ici", 85.5), ("", "a", 0.0), ("ab", "ab", 100.0),
])
def test_weighted_score_table(spark, a, b, score):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.weighted_ratio(F.col("a"), F.col("b")).alias("s")).first()
    assert row["s"] == pytest.approx(score)


@pytest.mark.parametrize("letters,longest,cut", [("ab1.", 9, 83), ("abcde.-", 16, 83), ("abc ", 12, 83), ("abcd", 14, 90), ("abcdef", 30, 88)])
def test_weighted_pairs_equal_brute_force(spark, letters, longest, cut):
    rng = random.Random(longest)
    left = ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(70)]
    right = []
    for w in left + left:
        n = rng.randint(0, len(w))
        right += [w[:n] + rng.choice(letters) + w[n + 1 :], w[n:], w[: n + 1] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 20)))]
    # texts that repeat one letter as their only word are compared with short texts only
    plain = lambda words: sorted({w for w in words if len(w) == 1 and w.strip() or len(" ".join({*w.split()})) > 1})
    left, right = plain(left), plain(right)
    got = matching.similar_pairs(
        spark.createDataFrame([(w,) for w in left], "id string"), spark.createDataFrame([(w,) for w in right], "k string"), cut, "weighted"
    ).collect()
    expected = {(a, b): s for a in left for b in right if (s := plain_weighted(a, b)) >= cut - 1e-9}
    assert {(r["id"], r["known"]): r["score"] for r in got} == pytest.approx(expected) and len(got) == len(expected)
    assert len(expected) > 50


def test_three_candidates_best_first(spark):
    known = ["gr1.mil-ter", "gr1.mil-tar", "gr1.mil-ter-sud", "gr1.mil-terr", "gr9.autre-lieu"]
    row = matching.fuzzy_id_match(
        spark.createDataFrame([("gr1.mil-ter",)], "id string"), spark.createDataFrame([(k,) for k in known], "k string"), threshold=88, margin=5
    ).first()
    scores = sorted(((plain_weighted("gr1.mil-ter", k), k) for k in known), key=lambda s: (-s[0], s[1]))[:3]
    assert [(c["known"], c["score"]) for c in row["candidates"]] == [(k, pytest.approx(s)) for s, k in scores]
    assert (row["accepted"], row["needs_review"]) == (False, True)


def test_a_known_id_that_holds_the_read_one_is_taken(spark):
    row = matching.fuzzy_id_match(
        spark.createDataFrame([("gr1.mil",)], "id string"), spark.createDataFrame([("gr1.mil-ter-bagadou",), ("gr2.sud",)], "k string")
    ).first()
    assert (row["best_id"], row["best_score"], row["accepted"], row["needs_review"]) == ("gr1.mil-ter-bagadou", 90.0, True, True)


def test_indel_candidates_equal_brute_force(spark):
    rng = random.Random(1)
    left = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(40)})
    right = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(40)})
    got = matching.fuzzy_id_match(
        spark.createDataFrame([(w,) for w in left], "id string"), spark.createDataFrame([(w,) for w in right], "k string"),
        metric="indel", threshold=88, margin=5,
    ).collect()
    best = {a: max(ratio(a, b) for b in right) for a in left}
    assert {r["id"]: r["best_score"] for r in got} == pytest.approx({a: s for a, s in best.items() if s >= 88})


def test_fuzzy_match_accepts_a_clear_winner_only(spark):
    def match(read, *known):
        return matching.fuzzy_id_match(
            spark.createDataFrame([(read,)], "id string"), spark.createDataFrame([(k,) for k in known], "k string")
        ).first()

    row = match("gr1.mil-ter-bagadoudorp", "gr1.mil-ter-bagadoudoro", "gr2.vallon-des-acacias")
    assert (row["best_id"], row["accepted"], row["needs_review"]) == ("gr1.mil-ter-bagadoudoro", True, True)
    close = match("gr1.mil-ter-doudors", "gr1.mil-ter-doudoro", "gr1.mil-ter-doudorx")
    assert (close["accepted"], close["needs_review"]) == (False, True)
    assert match("gr9.autre", "gr1.mil-ter-doudoro") is None


@pytest.mark.parametrize("fuzzy", [False, True])
def test_application_detection_ignores_registry_order(spark, fuzzy):
    registry = [("1", "fieldcoach", "FieldCoach", ["field coach"]), ("2", "plotcoach", "PlotCoach", [])]
    texts = spark.createDataFrame([("bienvenue FIELD COACH v2",), ("fieldcoach et plotcoach",), ("",), ("rien",)], "text string")
    for apps in (registry, registry[::-1]):
        found = [r["application_id"] for r in matching.detect_application(texts, apps, fuzzy=fuzzy).collect()]
        assert found == ["1", None, None, None]
    if fuzzy:
        noisy = spark.createDataFrame([("ecran fieldcoacn ouvert",)], "text string")
        assert matching.detect_application(noisy, registry, fuzzy=True, margin=5).first()["detection_score"] > 85


def test_attach_media_by_name_then_by_order(spark):
    messages = spark.createDataFrame([
        ("m1", dt.datetime(2026, 7, 1), "__unnamed_attachment__"), ("m2", dt.datetime(2026, 7, 2), "b.jpg"),
        ("m3", dt.datetime(2026, 7, 3), "__unnamed_attachment__"), ("m4", dt.datetime(2026, 7, 4), "gone.jpg"),
        ("m5", dt.datetime(2026, 7, 5), "__unnamed_attachment__"), ("m6", dt.datetime(2026, 7, 6), None),
    ], "message_id string, message_date timestamp_ntz, media_filename string")
    files = spark.createDataFrame([("c.jpg",), ("a.jpg",), ("b.jpg",)], "file_name string")
    out = {r["message_id"]: r["file_name"] for r in matching.attach_media(messages.repartition(4), files).collect()}
    assert out == {"m1": "a.jpg", "m2": "b.jpg", "m3": "c.jpg"}


def test_content_dedup_points_to_the_first(spark):
    files = spark.createDataFrame([(2, "x", 5), (1, "x", 6), (3, "x", 5), (4, "y", 1)], "evidence_id int, sha256 string, received_at int")
    rows = {r["evidence_id"]: r["duplicate_of_id"] for r in windows.content_dedup(files, "sha256").collect()}
    assert rows == {1: 2, 2: None, 3: 2, 4: None}


@pytest.mark.parametrize("slot", ["minute", "hour", "year"])
def test_state_changes_do_not_depend_on_slots(spark, slot):
    rng = random.Random(2)
    rows = [(i, rng.choice("kl"), dt.datetime(2026, 1, 1) + dt.timedelta(seconds=rng.randint(0, 9000)), rng.choice(["A", "B", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, key string, ts timestamp_ntz, state string")
    expected, last = set(), {}
    for i, key, ts, state in sorted(rows, key=lambda r: (r[2], r[0])):
        if state is not None and last.get(key) != state:
            expected.add((i, last.get(key)))
            last[key] = state
    got = windows.state_changes(df, "key", "ts", "state", "event_id", slot).collect()
    assert {(r["event_id"], r["previous_state"]) for r in got} == expected


def test_readings_frames_and_picks(spark):
    readings = spark.createDataFrame([
        (1, 1, "", 0.9), (1, 2, "deux", 0.8), (1, 3, "trois", 0.7), (1, 4, "quatre", 0.6), (2, 5, "", 0.2),
    ], "proof_id int, reading_id int, text string, confidence double")
    rows = {r["proof_id"]: r for r in windows.best_reading(readings).collect()}
    assert (rows[1]["best_reading_id"], rows[1]["combined_text"]) == (2, "deux\ntrois")
    assert (rows[2]["best_reading_id"], rows[2]["is_read"], rows[2]["combined_text"]) == (5, False, "")
    shots = spark.createDataFrame([(1, i, i, i in (2, 4)) for i in range(7)] + [(2, 9, 0, False)],
                                  "proof_id int, frame_id int, place int, is_visual boolean")
    picks = windows.representative_picks(shots).orderBy("proof_id", "pick").collect()
    assert [(r["proof_id"], r["frame_id"]) for r in picks] == [(1, 4), (1, 2), (1, 0), (2, 9)]
    stills = spark.createDataFrame([(1, 1, "end", False), (1, 2, "start", True), (2, 3, "start", False), (2, 4, "end", False)],
                                   "proof_id int, frame_id int, position string, is_selected_best boolean")
    assert {r["proof_id"]: r["frame_id"] for r in windows.best_frame(stills).collect()} == {1: 2, 2: 4}


def test_budget_equals_plain_greedy(spark):
    rng = random.Random(4)
    rows = [(b, b * 1000 + i, i, rng.choice([1, 3, 3, 5, 8, 30])) for b in range(4) for i in range(60)]
    images = spark.createDataFrame(rows, "batch_id int, image_id int, place int, size int")
    expected = set()
    for batch in range(4):
        used = 0
        for b, image, _, size in rows:
            if b == batch and size <= 10 and used + size <= 50:
                used += size
                expected.add((b, image))
    got = windows.budget_select(images, per_item=10, total=50).collect()
    assert {(r["batch_id"], r["image_id"]) for r in got} == expected


EVENT = ("evidence_id bigint, event_id bigint, at_time timestamp_ntz, kind string, new_group string, new_date string, "
         "new_status string")


def test_reviews_fold_in_time_order(spark, submissions):
    subs = submissions(
        dict(group_id=None, sync_date=None, date_is_ambiguous=True, requires_review=True, processing_status="REQUIRES_REVIEW"),
        dict(sync_status="FAILED", processing_status="REQUIRES_REVIEW"), dict(), dict(), dict(group_id=None),
    )
    def t(h):
        return dt.datetime(2026, 8, 1, h)
    events = spark.createDataFrame([
        (1, 1, t(1), "correct", "gr9.z", None, None), (1, 2, t(2), "correct", "", "2026-07-01", None),
        (2, 3, t(2), "validate", None, None, None), (2, 4, t(1), "reject", None, None, None),
        (3, 5, t(1), "reject", None, None, None), (4, 6, t(1), "status", None, None, "PENDING"),
        (5, 7, t(1), "reject", None, None, None), (5, 8, t(2), "correct", None, "2026-07-02", None),
    ], EVENT)
    rows = {r["evidence_id"]: r for r in reviews.apply_reviews(subs, events).collect()}
    first = rows[1]
    assert (first["group_id"], first["sync_date"], first["date_is_ambiguous"], first["requires_review"],
            first["processing_status"]) == ("gr9.z", "2026-07-01", False, False, "COMPLETED")
    assert (rows[2]["sync_status"], rows[2]["processing_status"]) == ("SUCCESS", "COMPLETED")
    assert rows[3]["processing_status"] == "FAILED"
    assert rows[4]["processing_status"] == "COMPLETED"  # transitional states cannot be set by hand
    assert (rows[5]["processing_status"], rows[5]["sync_date"]) == ("FAILED", "2026-07-02")  # the group is still unknown
    assert reviews.review_history(events).count() == 4


FRAME = ("proof_id int, frame_id int, position string, offset_seconds int, duration_seconds int, text string, "
         "check_visible boolean, confidence double")


def fold(spark, code, *rows):
    full = [(1, i, p, o, 100, t, c, 0.9) for i, (p, o, t, c) in enumerate(rows)]
    apps = spark.createDataFrame([(1, code)], "proof_id int, code string")
    return frames.frame_state(spark.createDataFrame(full, FRAME), apps).first()


def test_last_explicit_state_wins(spark):
    assert fold(spark, "terrain", ("start", 1, "Failed", False), ("end", 2, "completed", False), ("middle", 50, "", False))["sync_status"] == "SUCCESS"
    assert fold(spark, "terrain", ("end", 2, "completed", False), ("end", 1, "Failed", False))["sync_status"] == "FAILED"
    assert fold(spark, "terrain", ("start", 1, "completed", False), ("end", 2, "en cours", False))["sync_status"] == "UNCONFIRMED"
    panel = "Enregistrement de l'ecran Bluetooth Tout effacer Failed"
    assert fold(spark, "terrain", ("start", 1, "completed", False), ("end", 1, panel, False))["sync_status"] == "SUCCESS"


def test_visible_check_rule(spark):
    assert fold(spark, "fieldcoach", ("start", 1, "completed", False))["sync_status"] == "SUCCESS"
    later = fold(spark, "fieldcoach", ("start", 1, "completed", False), ("middle", 5, "upload complete", False), ("end", 1, "en cours", False))
    assert (later["sync_status"], later["evidence_text"]) == ("SUCCESS", "completed")  # the first words of success stand
    assert fold(spark, "fieldcoach", ("start", 1, "completed", False), ("middle", 5, "Failed", False), ("end", 1, "en cours", False))["sync_status"] == "UNCONFIRMED"
    for code in ("watercoach", "yebcoach", "financecoach", "pfnlcoach", "agricoach"):
        assert fold(spark, code, ("start", 1, "completed", False))["sync_status"] == "UNCONFIRMED"
        assert fold(spark, code, ("start", 1, "completed", False))["evidence_text"] is None
        assert fold(spark, code, ("start", 1, "Failed", False), ("end", 9, "completed", False))["sync_status"] == "FAILED"
    assert fold(spark, "pfnlcoach", ("start", 1, "Failed", False), ("end", 9, "Upload Data", False))["sync_status"] == "UNCONFIRMED"
    assert fold(spark, "agricoach", ("start", 1, "Failed", False), ("end", 9, "en cours", False))["sync_status"] == "UNCONFIRMED"
    assert fold(spark, "watercoach", ("start", 1, "Failed", False), ("end", 9, "en cours", False))["sync_status"] == "FAILED"
    assert fold(spark, "fieldcoach", ("start", 1, "", True), ("end", 1, "en cours", False))["sync_status"] == "SUCCESS"
    assert fold(spark, "fieldcoach", ("start", 1, "", True), ("end", 1, "Failed", True))["sync_status"] == "FAILED"
    assert fold(spark, "fieldcoach", ("start", 1, "Failed", False), ("end", 1, "", True))["sync_status"] == "SUCCESS"


def test_extraction_outcome(spark):
    rows = [
        (1, 1, "start", 1, 100, "GR1. zone nord\nJeudi 30 juillet 2026", False, 0.9),
        (1, 2, "end", 1, 100, "Synchronisation réussie", False, 0.7),
        (2, 3, "start", 1, 100, "rien", False, 0.4), (2, 4, "end", 1, 100, "grO.est 30/07/2026 completed", False, 0.4),
        (3, 5, "start", 1, 100, "gr1.zone-norb\n30 juillet", False, 0.9),
        (4, 6, "end", 9, 100, "lot\nSynchronisation", False, 0.9), (4, 7, "end", 8, 100, "réussie", False, 0.9),
        (5, 8, "start", 1, 100, "gr1.zone-nord5", False, 0.9), (6, 9, "start", 1, 100, "GRx.zone-nord", False, 0.9),
    ]
    known = spark.createDataFrame([("gr1.zone-nord",), ("gr8.autre-village",)], "k string")
    out = {r["proof_id"]: r for r in frames.extraction_outcome(spark.createDataFrame(rows, FRAME), known).collect()}
    assert (out[1]["group_id"], out[1]["sync_date"], out[1]["sync_status"]) == ("gr1.zone-nord", "2026-07-30", "SUCCESS")
    assert (out[1]["requires_review"], out[1]["global_confidence"]) == (False, 0.925)
    assert (out[2]["group_id"], out[2]["id_method"], out[2]["sync_date"]) == ("gr0.est", "regex_corrige", "2026-07-30")
    assert "insuffisamment lisible" in out[2]["review_reasons"]
    assert (out[3]["group_id"], out[3]["sync_date"]) == ("gr1.zone-norb", None)
    assert "meilleur: gr1.zone-nord, score 92.3" in out[3]["review_reasons"] and "Annee absente" in out[3]["review_reasons"]
    assert out[4]["sync_status"] == "SUCCESS"  # words that go on in the next frame
    close = spark.createDataFrame([("gr1.zone-nord1",), ("gr1.zone-nord2",)], "k string")
    raced = {r["proof_id"]: r for r in frames.extraction_outcome(spark.createDataFrame(rows, FRAME), close).collect()}
    assert "non reconnu avec certitude" in raced[5]["review_reasons"]
    near = spark.createDataFrame([("grx.zone-nord",)], "k string")
    fixed = {r["proof_id"]: r for r in frames.extraction_outcome(spark.createDataFrame(rows, FRAME), near).collect()}
    assert (fixed[6]["group_id"], fixed[6]["id_method"]) == ("grx.zone-nord", "correction_floue")


def test_retention_protects_shared_and_pending_paths(spark, submissions):
    old, new = dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 30)
    subs = submissions(
        dict(received_at=old), dict(received_at=new), dict(received_at=old, processing_status="PENDING"),
        dict(received_at=old), dict(received_at=old), dict(received_at=old),
    ).withColumn("storage_path", F.element_at(F.array(*[F.lit(p) for p in (
        "uploads/a.jpg", "uploads/shared.jpg", "uploads/p.jpg", "uploads/shared.jpg", "../etc/x.jpg", "uploads/job.png"
    )]), F.col("evidence_id").cast("int")))
    stills = spark.createDataFrame([(1, "frames/1.png"), (2, "frames/2.png"), (99, "frames/lost.png")], "evidence_id bigint, storage_path string")
    jobs = spark.createDataFrame([(6, "PROCESSING"), (1, "COMPLETED")], "evidence_id bigint, status string")
    plan = {r["path"]: r["removable"] for r in listing.retention_plan(subs, stills, jobs, "2026-07-31 00:00:00").collect()}
    assert plan == {"uploads/a.jpg": True, "frames/1.png": True, "../etc/x.jpg": False}


def test_csv_round_trip_numbers_lines_and_keeps_empty_cells(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text('id,date\ngr1.a,2026-07-30\n,\n"gr2, b",x\n', encoding="utf-8")
    rows = readers.read_tabular(spark, str(path), {"group_id": "id"}).orderBy("row_number").collect()
    assert [tuple(r) for r in rows] == [("gr1.a", "2026-07-30", 2), ("", "", 3), ("gr2, b", "x", 4)]
    assert readers.preview(readers.read_tabular(spark, str(path)), 1).count() == 1
    big = tmp_path / "big.csv"
    big.write_text("n\n" + "".join(f"{i}\n" for i in range(5000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        wrong = readers.read_tabular(spark, str(big)).where(F.col("row_number") != F.col("n").cast("int") + 2).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert wrong == 0


def test_expected_list_separator_and_mark(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("﻿id;x\ngr1.a;1\n", encoding="utf-8")
    assert [r[0] for r in readers.read_expected(spark, str(path)).collect()] == ["id", "gr1.a"]


def test_chat_log_shapes(spark, tmp_path):
    path = tmp_path / "chat.txt"
    path.write_text(
        "30/07/2026, 10:28 - Ali K: voici IMG-1.jpg\n‎[30/07/26, 10:28:03] Awa: image omitted\nsuite\n"
        "07/30/2026, 9:05 - Awa: bonjour\n31/31/2026, 9:05 - Awa: rien\n", encoding="utf-8")
    rows = readers.read_chat_log(spark, str(path)).collect()
    assert [(r["sent_at"], r["sender"], r["media_filename"]) for r in rows] == [
        (dt.datetime(2026, 7, 30, 10, 28), "Ali K", "IMG-1.jpg"),
        (dt.datetime(2026, 7, 30, 10, 28, 3), "Awa", "__unnamed_attachment__"),
        (dt.datetime(2026, 7, 30, 9, 5), "Awa", None), (None, "Awa", None),
    ]


def test_manifest_and_safe_csv(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.JPG").write_bytes(b"12")
    (tmp_path / "in" / "sub" / "b.mp4").write_bytes(b"123")
    (tmp_path / "in" / "c.txt").write_bytes(b"1")
    found = readers.file_manifest(spark, str(tmp_path / "in")).collect()
    assert {(r["name"], r["ext"], r["size"]) for r in found} == {("a.JPG", ".jpg", 2), ("b.mp4", ".mp4", 3)}
    df = spark.createDataFrame([("=1", None, [1], 5)], "a string, b string, c array<int>, d int").coalesce(1)
    sinks.safe_csv_sink(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text == "a;b;c;d\n'=1;;[1];5\n"


def test_scratch_follows_the_named_folder(spark):
    folder = scratch(spark, "x")
    assert folder.startswith("/tmp/") and scratch(spark, "x") != folder


def test_budget_walks_each_batch_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.randrange(40), rng.choice([0, 3, 7, 7, 25, 60, 101])) for i in range(400)]
    got = windows.budget_select(spark.createDataFrame(rows, "batch_id int, image_id bigint, place int, size int"), 100, 150).collect()
    expected = []
    for batch in (1, 2, 3, None):
        used, turn = 0, 0
        for _, image, _, size in sorted((r for r in rows if r[0] == batch), key=lambda r: (r[2], r[1])):
            if size <= 100 and used + size <= 150:
                expected.append((batch, turn, image))
                used, turn = used + size, turn + 1
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_campaign_lists(spark):
    runs = spark.createDataFrame([(i, dt.datetime(2026, 7, 1) + dt.timedelta(hours=i // 2), f"r{i}") for i in range(70)], "run_id int, created_at timestamp_ntz, result string")
    assert [r["run_id"] for r in stats.campaign_runs(runs).collect()] == [*range(69, 39, -1)]
    sent = spark.createDataFrame([("2026-07-01", "b", "SENT"), ("2026-07-02", "c", "SENT"), ("2026-07-02", "a", "UNKNOWN")], "day string, recipient string, status string")
    assert [tuple(r) for r in stats.campaign_recipients(sent, 2).collect()] == [("2026-07-02", "a", "UNKNOWN"), ("2026-07-02", "c", "SENT")]
