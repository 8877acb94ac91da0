"""First, last, ranked and changed rows per key.

Wherever a single row or a few rows per key are wanted, tasks reduce their own
rows first (aggregates, or a ranked limit that Spark applies before the
shuffle), so a hot key never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.joins import first_by, lookup, split_join
from proofline.functions.text import has_text


def content_dedup(files: DataFrame, hash_col: str, order: Sequence[str] = ("received_at", "evidence_id"),
                  ident: str = "evidence_id") -> DataFrame:
    """Adds duplicate_of_id: the first file with the same content, null for that first file and where the hash is unknown."""
    known = files.where(F.col(hash_col).isNotNull())
    first = first_by(known, [hash_col], list(order), [ident]).withColumnRenamed(ident, "first_id")
    return lookup(files, first, hash_col, ident).withColumn(
        "duplicate_of_id", F.when(F.col(ident) != F.col("first_id"), F.col("first_id"))
    ).drop("first_id")


def latest_run(runs: DataFrame, app: str | None = None) -> DataFrame:
    """The last completed run, of one application if given: one row or none."""
    done = runs.where(F.col("status") == "COMPLETED")
    if app is not None:
        done = done.where(F.col("application_id") == app)
    return done.orderBy(F.col("finished_at").desc(), F.col("run_id").desc()).limit(1)


def latest_explicit_state(
    frames: DataFrame, key: str = "proof_id", state: str = "state", order: Sequence[str] = ("at_time", "frame_id")
) -> DataFrame:
    """Per proof, the state of its last frame that shows one."""
    shown = frames.where(F.col(state).isNotNull())
    return shown.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def state_changes(
    df: DataFrame, key: str, order: str, state: str, ident: str, slot: str = "minute", fine: str = "millisecond"
) -> DataFrame:
    """Rows whose state differs from the previous non-null one of the key.

    A key is cut into time slots and these into fine ones. The first row of a fine
    slot is compared with the last state of the fine slot before it, or else of
    the slot before: tables with one row for each fine slot and each slot. Only rows
    of one key within the same fine slot have to fit one task.
    """
    rows = df.where(F.col(state).isNotNull()).withColumns({"__slot": F.date_trunc(slot, order), "__fine": F.date_trunc(fine, order)})
    cell = [key, "__slot", "__fine"]
    inside = Window.partitionBy(*cell).orderBy(order, ident)
    rows = rows.withColumn("__before", F.lag(state).over(inside)).withColumn(
        "__first", F.row_number().over(inside) == 1
    )
    fines = rows.groupBy(*cell).agg(F.max_by(state, F.struct(order, ident)).alias("__end"))
    slots = fines.groupBy(key, "__slot").agg(F.max_by("__end", "__fine").alias("__end"))
    slots = slots.select(key, "__slot", F.lag("__end").over(Window.partitionBy(key).orderBy("__slot")).alias("__far"))
    near = F.lag("__end").over(Window.partitionBy(key, "__slot").orderBy("__fine"))
    fines = fines.select(*cell, near.alias("__near")).join(slots, [key, "__slot"], "left")
    joined = rows.join(fines.select(*cell, F.coalesce("__near", "__far").alias("__carried")), cell, "left")
    before = F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__before"))
    return joined.where(before.isNull() | (before != F.col(state))).withColumn(
        "previous_state", before
    ).drop("__slot", "__fine", "__before", "__first", "__carried")


def best_reading(readings: DataFrame, top_n: int = 3) -> DataFrame:
    """Per proof: the surest non-empty reading, and the distinct texts of the top `top_n` readings.

    Readings rank by confidence, then id. `is_read` tells whether any text was there.
    """
    rank = Window.partitionBy("proof_id").orderBy(F.col("confidence").desc(), F.col("reading_id"))
    top = readings.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top_n)
    texts = F.transform(
        F.array_sort(F.collect_list(F.when(
            F.coalesce(F.col("text") != "", F.lit(False)), F.struct("place", "text")
        ))), lambda r: r["text"],
    )
    combined = top.groupBy("proof_id").agg(
        F.array_join(F.array_distinct(texts), "\n").alias("combined_text")
    )
    order = F.struct(
        (~has_text(F.col("text"))).alias("empty"), (-F.col("confidence")).alias("c"), F.col("reading_id").alias("i")
    )
    best = readings.groupBy("proof_id").agg(
        F.min_by(F.struct("reading_id", "text", "confidence"), order).alias("best")
    )
    return best.join(combined, "proof_id").select(
        "proof_id", F.col("best.reading_id").alias("best_reading_id"), F.col("best.text").alias("best_text"),
        F.col("best.confidence").alias("best_confidence"), has_text(F.col("best.text")).alias("is_read"),
        "combined_text",
    )


def representative_picks(frames: DataFrame, n: int = 3) -> DataFrame:
    """At most `n` frames per proof: visual ones newest first, then the first, middle and last.

    Frames have `place` (0-based order within the proof) and `is_visual`.
    """
    sizes = frames.groupBy("proof_id").agg(F.count("*").alias("frames"))
    rows = split_join(frames, sizes, ["proof_id"])
    spread = (
        F.when(F.col("place") == 0, 0).when(F.col("place") == F.floor(F.col("frames") / 2), 1)
        .when(F.col("place") == F.col("frames") - 1, 2)
    )
    rows = rows.withColumn("turn", F.when(F.col("is_visual"), 0).otherwise(1)).withColumn(
        "within", F.when(F.col("is_visual"), -F.col("place")).otherwise(spread.cast("bigint"))
    ).where("within IS NOT NULL")
    rank = Window.partitionBy("proof_id").orderBy("turn", "within", "frame_id")
    return rows.withColumn("pick", F.row_number().over(rank)).where(F.col("pick") <= n).select(
        "proof_id", "pick", "frame_id", "place", "is_visual"
    )


def best_frame(frames: DataFrame) -> DataFrame:
    """One frame per proof: a selected one first, then one of the end, then the lowest id."""
    order = ["unselected", "not_end", "frame_id"]
    keyed = frames.withColumns({
        "unselected": ~F.col("is_selected_best"), "not_end": F.col("position") != "end"
    })
    return first_by(keyed, ["proof_id"], order, ["frame_id", "position", "is_selected_best"])


def budget_select(images: DataFrame, per_item: int = 2_000_000, total: int = 10_000_000) -> DataFrame:
    """(batch_id, turn, image_id): images of each batch kept within a byte budget, in order; one that does not fit is skipped.

    Whether an image fits depends on which earlier ones did, so this is a fold
    and not a running sum. The remaining budget only shrinks: of the images of
    one exact size, none after the first `total / size` can be kept, and those
    are dropped first. The fold walks over the sorted rows of a task and carries
    the bytes used so far, so memory does not grow with a batch.
    """
    same_size = Window.partitionBy("batch_id", "size").orderBy("place", "image_id")
    fit = images.where(F.col("size") <= per_item).withColumn("nth", F.row_number().over(same_size))
    fit = fit.where(F.col("nth") <= F.lit(total) / F.greatest(F.col("size"), F.lit(1)))
    rows = fit.select("batch_id", "place", F.col("image_id").cast("bigint").alias("image_id"), F.col("size").cast("bigint").alias("size"))
    walked = rows.repartition("batch_id").sortWithinPartitions("batch_id", "place", "image_id")
    kind = rows.schema["batch_id"].dataType.simpleString()

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, turn = object(), 0, 0  # no batch is equal to it
        for part in parts:
            kept, turns = [], []
            for row, (batch, size) in enumerate(zip(part["batch_id"].to_pylist(), part["size"].to_pylist(), strict=True)):
                if batch != current:
                    current, used, turn = batch, 0, 0
                if used + size <= total:
                    kept.append(row)
                    turns.append(turn)
                    used, turn = used + size, turn + 1
            taken = part.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken["batch_id"], pa.array(turns, pa.int32()), taken["image_id"]], ["batch_id", "turn", "image_id"])

    return walked.mapInArrow(fold, f"batch_id {kind}, turn int, image_id bigint")
