"""Helpers shared by the text operators: stored tables, one-row tables, Arrow batches in bounded slices."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of these modules travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session; a temporary one only for a local master without it."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="proofline-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: short lineage that outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Lets Spark hand texts to Python few at a time: they may be long, and both sides hold whole batches, outside the heap too."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", 4 * rows)):
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def text_of(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of one slice stay near `limit` bytes; a longer text stands alone."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(at)] if batch.num_rows else []
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def sent(spark: SparkSession, value: object) -> tuple[Callable[[], object], Broadcast]:
    """Broadcasts a value of bounded size, with its class, so that workers need no install of this package.

    Gives the function that reads it in a task, and the broadcast, which may be destroyed once no task needs it.
    """
    pickled = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get() -> object:
        if not held:
            held.append(cloudpickle.loads(pickled.value))
        return held[0]

    return get, pickled
