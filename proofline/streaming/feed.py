"""The message feed and case upkeep as Structured Streaming.

Stateless rules work on batch and streaming DataFrames alike. Where the result
needs history, a micro-batch is reduced first (aggregates with map-side
combine), joined with tables written by earlier batches, and written under its
own batch id, so that a repeated batch overwrites itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofline import constants as K
from proofline.functions import predicates as P
from proofline.functions.joins import first_by, lookup
from proofline.streaming.casework import case_state_sink  # noqa: F401
from proofline.streaming.keylog import KeyLog


def run_available(
    stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, mode: str = "append"
) -> None:
    """Processes everything there is, then stops. `sink` is a folder or a batch function."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query: StreamingQuery = (
        writer.format("parquet").option("path", sink).start() if isinstance(sink, str)
        else writer.foreachBatch(sink).start()
    )
    query.awaitTermination()


def batch_folder(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id}"


def read_batches(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Rows written by earlier batches, or None when there are none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.option("basePath", root).parquet(root)
    return rows if before is None else rows.where(F.col("batch") < before)


def latest_rows(rows: DataFrame, keys: list[str], version: Sequence[str] = ()) -> DataFrame:
    """For each key the row of its newest batch; within a batch the one with the largest `version` columns.

    Versions that tie are told apart by the row's values, so the outcome never depends on the order of arrival.
    """
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), F.struct("batch", *version, *values)).alias("v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "v.*")


def stream_dedup(messages: DataFrame) -> DataFrame:
    """Each message id once, however late a message or its repeat comes: late messages stay, an id is never taken twice.

    On a stream the ids live in the state store, looked up by key in each micro-batch (use the RocksDB store for large
    feeds). No watermark bounds the state, since forgetting an id would process it again; `dedup_sink` keeps the ids in
    tables instead, and no state at all.
    """
    return messages.dropDuplicates(["message_id"])


def dedup_sink(
    root: str, key: str = "message_id", order: Sequence[str] = ("message_date",), rows: int = 100_000, fan: int = 8
) -> Callable[[DataFrame, int], None]:
    """Batch function: each key once, of all batches, with nothing in the state store.

    Of the rows of a key in one batch the first by `order` and then by its values stays. Writes `<root>/new` (the rows
    that stay, by batch) and `<root>/keys` (a `KeyLog`, whose buckets hold about `rows` keys and whose runs merge `fan`
    at a time).
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        log = KeyLog(batch.sparkSession, f"{root}/keys", key, rows=rows, fan=fan)
        values = [c for c in batch.columns if c not in (key, *order)]
        own = first_by(batch, [key], [*order, *values], [*order, *values])
        asked = _kept(own, f"{root}/asked", batch_id)
        known = log.earlier(asked, batch_id).withColumnRenamed(key, "__known")
        fresh = asked.join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti").select(*batch.columns)
        fresh = _kept(fresh, f"{root}/new", batch_id)
        log.add(fresh, batch_id)

    return process


def _kept(rows: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Writes rows of a batch under its id and reads them back, so that all that follows sees the same."""
    path = batch_folder(root, batch_id)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stream_late(messages: DataFrame, cutoff: dt.datetime | str) -> DataFrame:
    """Adds is_late: older than the reset instant. Late rows are kept."""
    return messages.withColumn("is_late", P.cutoff_filter(F.col("message_date"), cutoff))


def stream_route(
    messages: DataFrame, channels: DataFrame, cutoff: dt.datetime | str, manifest: DataFrame | None = None
) -> DataFrame:
    """Adds route and route_note; the first rule that applies wins.

    Before the cutoff, then not downloaded, then a channel that is not
    monitored (or unknown), then a missing file; the rest is ACCEPTED. With a
    `manifest` of paths, a file must be listed in it.
    """
    watched = channels.select("channel_id", "is_monitored")
    rows = messages.join(watched, "channel_id", "left")
    missing = F.coalesce(F.col("storage_path") == "", F.lit(True))
    if manifest is not None:
        listed = manifest.select(F.col("path").alias("storage_path")).distinct().withColumn("listed", F.lit(True))
        rows = lookup(rows, listed, "storage_path", "message_id")
        missing = missing | F.col("listed").isNull()
    late = P.cutoff_filter(F.col("message_date"), cutoff)
    monitored = F.coalesce("is_monitored", F.lit(False))
    fetched = F.coalesce(F.col("download_status") == "DOWNLOADED", F.lit(False))
    return rows.withColumns({
        "route": F.when(late, "SKIPPED_NO_MEDIA").when(~fetched, F.col("download_status"))
        .when(~monitored, "SKIPPED_UNAUTHORIZED_GROUP").when(missing, "FAILED").otherwise("ACCEPTED"),
        "route_note": F.when(late, K.CUTOFF_NOTE).when(fetched & monitored & missing, K.MISSING_FILE_NOTE),
    })


def discover_channels(batch: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel_id, is_new, last_activity) of every channel in a batch; new ones start unmonitored."""
    seen = batch.groupBy("channel_id").agg(F.max("message_date").alias("last_activity"))
    known = channels.select("channel_id", F.lit(False).alias("is_new"))
    return seen.join(known, "channel_id", "left").select(
        "channel_id", F.coalesce("is_new", F.lit(True)).alias("is_new"), "last_activity"
    )


def content_dedup_sink(root: str, rows: int = 100_000, fan: int = 8) -> Callable[[DataFrame, int], None]:
    """Batch function: the first file of each content wins, across all batches. Unknown hashes are no copies.

    Writes `<root>/firsts` (a `KeyLog` of contents with their first file) and `<root>/files` (every file with
    duplicate_of_id). A batch reads, besides its own files, the buckets of `firsts` that may hold one of its contents.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        log = KeyLog(batch.sparkSession, f"{root}/firsts", "sha256", ["evidence_id"], rows, fan)
        known = batch.where("sha256 IS NOT NULL")
        own = _kept(first_by(known, ["sha256"], ["received_at", "evidence_id"], ["evidence_id"]), f"{root}/own", batch_id)
        earlier = log.earlier(own.select("sha256"), batch_id).withColumnRenamed("evidence_id", "earlier")
        # The resolved table is read back so that both outputs see the same firsts.
        own = _kept(own.join(earlier, "sha256", "left").select(
            "sha256", "evidence_id", F.col("earlier").cast(own.schema["evidence_id"].dataType).alias("earlier")
        ), f"{root}/resolved", batch_id)
        log.add(own.where("earlier IS NULL").select("sha256", "evidence_id"), batch_id)
        first = own.select("sha256", F.coalesce("earlier", "evidence_id").alias("first_id"))
        lookup(batch, first, "sha256", "evidence_id").withColumn(
            "duplicate_of_id", F.when(F.col("evidence_id") != F.col("first_id"), F.col("first_id"))
        ).drop("first_id").write.mode("overwrite").parquet(batch_folder(f"{root}/files", batch_id))

    return process


def gateway_transitions(events: DataFrame, key: str = "gateway_id", slot: str = "minute") -> DataFrame:
    """Heartbeats at which the connection state differs from the one before (batch form)."""
    from proofline.operators.windows import state_changes

    return state_changes(events, key, "at_time", "connection_state", "event_id", slot)


def gateway_sink(root: str) -> Callable[[DataFrame, int], None]:
    """Batch function: state changes of gateways across batches, right also for heartbeats that come late or without state.

    Heartbeats are kept by day. A batch touches some days of some gateways; these days are worked out anew, and the
    next day of each, whose first change may now be another. They begin with the last known state of the nearest
    earlier day. So a batch reads the days it touches and a table with one row per gateway and day. Writes
    `<root>/changes` and `<root>/done`; `gateway_changes` reads what holds.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        values = ["event_id", "gateway_id", "at_time", "connection_state"]
        own = batch.select(*values).withColumn("day", F.to_date("at_time"))
        own.write.mode("overwrite").partitionBy("day").parquet(batch_folder(f"{root}/beats", batch_id))
        beats = read_batches(spark, f"{root}/beats", batch_id + 1)
        ends = own.where("connection_state IS NOT NULL").groupBy("gateway_id", "day").agg(
            F.max(F.struct("at_time", "event_id", "connection_state")).alias("end")
        )
        ends.write.mode("overwrite").parquet(batch_folder(f"{root}/ends", batch_id))
        touched = spark.read.parquet(batch_folder(f"{root}/ends", batch_id)).select("gateway_id", "day")
        # batches of one day are folded by the largest end
        every = read_batches(spark, f"{root}/ends", batch_id + 1).join(touched.select("gateway_id").distinct(), "gateway_id", "left_semi")
        line = Window.partitionBy("gateway_id").orderBy("day")
        days = every.groupBy("gateway_id", "day").agg(F.max("end").alias("end")).withColumns({
            "before": F.lag("end.connection_state").over(line), "next_day": F.lead("day").over(line),
        })
        anew = days.join(touched, ["gateway_id", "day"], "left_semi")
        again = anew.select("gateway_id", "day").unionByName(
            anew.where("next_day IS NOT NULL").select("gateway_id", F.col("next_day").alias("day"))
        ).distinct()
        carried = days.join(again, ["gateway_id", "day"], "left_semi").select("gateway_id", "day", "before")
        rows = beats.where("connection_state IS NOT NULL").select(*values, "day").join(carried, ["gateway_id", "day"])
        inside = Window.partitionBy("gateway_id", "day").orderBy("at_time", "event_id")
        previous = F.coalesce(F.lag("connection_state").over(inside), "before")
        changed = rows.withColumn("previous_state", previous).where(
            "previous_state IS NULL OR previous_state <> connection_state"
        )
        changed.drop("before").write.mode("overwrite").parquet(batch_folder(f"{root}/changes", batch_id))
        carried.select("gateway_id", "day").write.mode("overwrite").parquet(batch_folder(f"{root}/done", batch_id))

    return process


def gateway_changes(spark: SparkSession, root: str) -> DataFrame:
    """The state changes that hold after all batches: of each gateway and day those of the last batch that worked it out."""
    done = read_batches(spark, f"{root}/done").groupBy("gateway_id", "day").agg(F.max("batch").alias("batch"))
    return read_batches(spark, f"{root}/changes").join(done, ["gateway_id", "day", "batch"], "left_semi").drop("batch", "day")


def tumbling_counts(messages: DataFrame, width: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Messages per channel and window of event time. Every message counts, however late, in update mode.

    A caller who can do without late messages may set a watermark, which bounds the state and drops what is later.
    """
    rows = messages.withWatermark("message_date", watermark) if watermark and messages.isStreaming else messages
    fetched = F.col("download_status") == "DOWNLOADED"
    return rows.groupBy(F.window("message_date", width).alias("w"), "channel_id").agg(
        F.count("*").alias("messages"), F.count_if(fetched).alias("downloaded")
    ).select(F.col("w.start").cast("date").cast("string").alias("day"), "channel_id", "messages", "downloaded")


def upsert_sink(root: str) -> Callable[[DataFrame, int], None]:
    """Batch function keeping each update batch; `latest_rows` reads the current state."""

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(root, batch_id))

    return process


def retry_budget(messages: DataFrame, max_attempts: int = K.MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """(messages to retry with their count raised, messages out of retries).

    A retried message that already has a submission counts as downloaded again.
    """
    left = F.col("retry_count") < max_attempts
    retried = messages.where(left).withColumns({
        "retry_count": F.col("retry_count") + 1,
        "download_status": F.when(F.col("evidence_id").isNotNull(), "DOWNLOADED")
        .otherwise(F.col("download_status")),
    })
    return retried, messages.where(~left)
