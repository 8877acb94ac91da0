"""From texts of time-ordered frames to one outcome per proof.

Frames have proof_id, frame_id, position (start, middle, end), offset_seconds,
text, confidence; `check_visible` says whether an image check was seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.dates import parse_report_date
from proofline.functions.ids import find_id_candidates, normalize_id
from proofline.functions.joins import lookup, split_join
from proofline.functions.status import sync_text_status
from proofline.functions.text import fold_text, has_text, let, non_empty, notification_panel
from proofline.operators.matching import fuzzy_id_match
from proofline.session import scratch

def frame_time(frames: DataFrame) -> Column:
    """Seconds from the beginning; offsets of end frames count back from the duration."""
    duration = F.col("duration_seconds") if "duration_seconds" in frames.columns else F.lit(0)
    offset = F.col("offset_seconds")
    return F.when(F.col("position") == "end", F.coalesce(duration, F.lit(0)) - offset).otherwise(offset)


def frame_state(
    frames: DataFrame, apps: DataFrame, success: Sequence[str] = K.SUCCESS_KEYWORDS,
    error: Sequence[str] = K.ERROR_KEYWORDS, fuzzy: bool = True,
) -> DataFrame:
    """(proof_id, sync_status, evidence_text, confidence) told by the frames in time order.

    `apps` gives the application code of each proof. Frames of a notification panel are ignored and a failure always
    counts. For plain codes the last frame with known words decides. Codes ending in `coach` follow these rules:

    - a visible check on a frame that does not fail is a success;
    - a success stands until a failure, whatever other frames say;
    - `watercoach`, `yebcoach` and `financecoach` listen to checks only, `pfnlcoach` also to its label, which confirms
      nothing, `agricoach` to all words but those of success, and any other code to all words.

    What decides is then either the last frame of some kind, or the first words of success after the last failure.
    Runs a job: what each frame says is stored.
    """
    rows = frames.join(apps.select("proof_id", "code"), "proof_id", "left")
    counted = F.col("position").isin("start", "middle", "end") & ~notification_panel(F.coalesce("text", F.lit("")))
    coach = F.coalesce(F.col("code").endswith(K.COACH_SUFFIX), F.lit(False))
    letters = F.regexp_replace(fold_text(F.col("text")), "[^a-z]", "")
    labelled = F.coalesce(reduce(lambda a, b: a | b, [letters.contains(x) for x in K.LABELS]), F.lit(False))

    def effect(kind: str, status: Column, matched: Column, confidence: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.struct(status.alias("status"), matched.alias("matched"), confidence.alias("confidence")).alias("told")
        )

    def judged(read: Column) -> Column:
        own = (read["status"], read["matched"], read["confidence"])
        said = read["matched"].isNotNull()
        return (
            F.when(read["status"] == "FAILED", effect("failure", *own))
            .when(~coach & said, effect("words", *own))
            .when(coach & F.coalesce("check_visible", F.lit(False)), effect(
                "check", F.lit("SUCCESS"), F.lit(K.TEXT_CHECK_VISIBLE), F.lit(K.CHECK_CONFIDENCE)))
            .when(coach & (F.col("code") == K.LABEL_CODE), F.when(labelled, effect(
                "doubt", F.lit("UNCONFIRMED"), F.lit(K.TEXT_LABEL_UNCONFIRMED), F.lit(0.0))))
            .when(~coach | ~said | F.col("code").isin(*K.CHECK_ONLY_CODES), F.lit(None))
            .when(read["status"] != "SUCCESS", effect("doubt", *own))
            .when(F.col("code") != K.NO_SUCCESS_WORDS_CODE, effect("good", *own))
        )

    rows = rows.withColumn("read", F.when(counted, sync_text_status(F.col("text"), success, error, fuzzy)))
    rows = rows.select(
        "proof_id", coach.alias("coach"), F.struct(frame_time(frames).alias("second"), "frame_id").alias("order"),
        F.when(F.col("read").isNotNull(), let(F.col("read"), judged)).alias("effect"),
    )
    # near spellings are sought once: what a frame says is read for the last frames and again for those after a failure
    path = scratch(frames.sparkSession, "frames")
    rows.write.parquet(path)
    rows = frames.sparkSession.read.schema(rows.schema).parquet(path)

    def last(kind: str) -> list[Column]:
        held = F.when(F.col("effect.kind") == kind, F.col("order"))
        return [F.max_by("effect.told", held).alias(kind), F.max(held).alias(f"{kind}_at")]

    ends = rows.groupBy("proof_id").agg(
        *last("failure"), *last("check"), *last("doubt"), F.bool_or("coach").alias("coach"),
        F.max_by("effect.told", F.when(F.col("effect").isNotNull(), F.col("order"))).alias("words"),
    )
    # only words of success for coach codes look back at the last failure; no other frame moves twice
    after = split_join(rows.where("effect.kind = 'good'"), ends.select("proof_id", "failure_at"), ["proof_id"])
    after = after.where(F.col("failure_at").isNull() | (F.col("order") > F.col("failure_at")))
    first = after.groupBy("proof_id").agg(F.min_by("effect.told", "order").alias("good"))
    ends = ends.join(first, "proof_id", "left")

    def later(place: str) -> Column:
        return F.col(place).isNotNull() & (F.col("failure_at").isNull() | (F.col(place) > F.col("failure_at")))

    told = (
        F.when(~F.col("coach"), F.col("words")).when(later("check_at"), F.col("check"))
        .when(F.col("good").isNotNull(), F.col("good")).when(later("doubt_at"), F.col("doubt")).otherwise(F.col("failure"))
    )
    return ends.withColumn("told", told).select(
        "proof_id", F.coalesce("told.status", F.lit("UNCONFIRMED")).alias("sync_status"),
        F.col("told.matched").alias("evidence_text"), F.coalesce("told.confidence", F.lit(0.0)).alias("confidence"),
    )


def extraction_outcome(
    texts: DataFrame, known: DataFrame | None = None, success: Sequence[str] = K.SUCCESS_KEYWORDS,
    error: Sequence[str] = K.ERROR_KEYWORDS, fuzzy: bool = True, metric: str = "weighted",
) -> DataFrame:
    """One row per proof: group id, date, status, confidences, review flag and reasons.

    The texts of the start frames are read as one, a line for each, and so are those of the end frames (a proof has a
    few of either). Id and date come from the start, and where it has none and the end says anything, from both; the
    status from the end. The id is the first piece that is valid or clearly close to a `known` one,
    by the `metric` of `fuzzy_id_match`. With `known`, runs jobs: the pieces are stored.
    """
    rows = texts.withColumn("order", F.struct(frame_time(texts).alias("second"), "frame_id"))
    joined = lambda position: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("position") == position, F.struct("order", F.coalesce("text", F.lit("")).alias("text"))
    ))), lambda r: r["text"]), "\n").alias(position)
    context = [F.first("context_date", ignorenulls=True).alias("context_date")] if "context_date" in texts.columns else []
    proofs = rows.groupBy("proof_id").agg(joined("start"), joined("end"), F.avg("confidence").alias("ocr"), *context)
    proofs = proofs.withColumn("both", F.concat("start", F.lit("\n"), "end")).withColumn("has_end", has_text(F.col("end")))
    pieces = lambda text, second: F.transform(find_id_candidates(text), lambda c, i: F.struct(
        F.lit(second).alias("second"), i.alias("i"), c.alias("raw")
    ))
    read = proofs.select("proof_id", F.explode(F.concat(
        pieces(F.col("start"), False), F.when(F.col("has_end"), pieces(F.col("both"), True)).otherwise(F.array().cast("array<struct<second:boolean,i:int,raw:string>>"))
    )).alias("piece")).select("proof_id", "piece", normalize_id(F.col("piece.raw")).alias("n"))
    read = read.withColumn("asked", F.coalesce("n.normalized", F.lower(F.trim("piece.raw"))))
    if known is not None:
        # the pieces are read for the match and for its outcome
        path = scratch(texts.sparkSession, "pieces")
        read.write.parquet(path)
        read = texts.sparkSession.read.schema(read.schema).parquet(path)
        near = fuzzy_id_match(read.select("asked"), known, metric).drop("candidates").withColumnRenamed("id", "asked")
        read = lookup(read, near, "asked", "proof_id")
    else:
        read = read.withColumns({
            "best_id": F.lit(None).cast("string"), "best_score": F.lit(None).cast("double"), "accepted": F.lit(None).cast("boolean"),
        })
    clear = F.coalesce("accepted", F.lit(False))
    found = read.where(F.col("n.valid") | clear).groupBy("proof_id").agg(F.min_by(
        F.struct("piece.raw", "n", "best_id", "best_score", "accepted"), F.struct("piece.second", "piece.i")
    ).alias("id"))
    date_of = lambda text: parse_report_date(F.col(text), F.col("context_date") if context else None)
    outcome = proofs.join(found, "proof_id", "left").withColumns({
        "first_date": date_of("start"), "any_date": date_of("both"), "status": sync_text_status(F.col("end"), success, error, fuzzy),
    })
    readable = F.col("first_date.normalized_date").isNotNull() | ~F.col("has_end")
    outcome = outcome.withColumn("date", F.when(readable, F.col("first_date")).otherwise(F.col("any_date"))).withColumns({
        "date": F.when(F.col("date.raw_text").isNotNull(), F.col("date")), "group_id": F.col("id.n.normalized"),
        "best_id": F.col("id.best_id"), "best_score": F.col("id.best_score"), "accepted": F.col("id.accepted"),
    })
    other = F.coalesce(F.col("accepted") & ~F.col("best_id").eqNullSafe(F.col("group_id")), F.lit(False))
    close = other & (F.col("best_score") < K.SURE_REPLACEMENT)
    replaced = other & ~close
    raced = F.coalesce(~F.col("accepted"), F.lit(False))
    id_confidence = F.when(replaced, F.col("best_score") / 100).otherwise(
        F.coalesce("id.n.confidence", F.lit(0.0))
    )
    date_confidence = F.coalesce("date.confidence", F.lit(0.0))
    sync = F.coalesce("status.status", F.lit("UNCONFIRMED"))
    sync_confidence = F.coalesce("status.confidence", F.lit(0.0))
    ocr = F.coalesce("ocr", F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.when(F.col("id").isNull(), K.REVIEW_NO_ID)
        .when(close, F.format_string(K.REVIEW_ID_CLOSE, "best_id", F.round("best_score", 1))).when(raced, K.REVIEW_ID_UNSURE),
        F.when(F.col("date").isNull(), K.REVIEW_NO_DATE).otherwise(F.col("date.note")),
        F.when(ocr < K.READABLE_CONFIDENCE, K.REVIEW_UNREADABLE),
        F.when(sync != "SUCCESS", K.REVIEW_SYNC),
    ))
    method = (
        F.when(replaced, "correction_floue")
        .when(F.size("id.n.corrections") > 0, "regex_corrige").when(F.col("group_id").isNotNull(), "regex")
    )
    total = (id_confidence + date_confidence + sync_confidence + ocr) / 4
    return outcome.select(
        "proof_id", F.col("id.raw").alias("raw_group_id"),
        F.when(replaced, F.col("best_id")).otherwise(F.col("group_id")).alias("group_id"),
        method.alias("id_method"), F.col("date.raw_text").alias("raw_date"),
        F.col("date.normalized_date").alias("sync_date"),
        F.coalesce("date.is_ambiguous", F.lit(True)).alias("date_is_ambiguous"),
        sync.alias("sync_status"), F.col("status.matched").alias("evidence_text"),
        id_confidence.alias("confidence_group"), date_confidence.alias("confidence_date"),
        sync_confidence.alias("confidence_sync"), F.round(total, 3).alias("global_confidence"),
        (F.size(reasons) > 0).alias("requires_review"),
        non_empty(F.array_join(reasons, "; ")).alias("review_reasons"),
    )
