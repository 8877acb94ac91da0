"""Tables of a stream kept by day: a batch reads the days it asks for and overwrites only what it has written itself."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a missing day in the name of a folder.
NO_DAY = "none"


def day_of(column: Column) -> Column:
    """The day of an instant, or of a text that begins as one, as the name of a folder."""
    text = column.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)), F.lit(NO_DAY))


def days_of(*columns: tuple[DataFrame, str]) -> list[str]:
    """The distinct days in some columns: no more than the calendar has."""
    found = None
    for rows, name in columns:
        own = rows.select(F.col(name).alias("day")).where("day IS NOT NULL").distinct()
        found = own if found is None else found.unionByName(own)
    return sorted(r[0] for r in found.distinct().collect())


class DayTable:
    """Rows under `<root>/<day column>=<day>/batch=<batch>`."""

    def __init__(self, spark: SparkSession, root: str, fields: Sequence[T.StructField], day: str):
        self.spark, self.root, self.day = spark, root, day
        self.schema = T.StructType([*[f for f in fields if f.name not in (day, "batch")], T.StructField(day, T.StringType()), T.StructField("batch", T.LongType())])
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Writes rows of a batch; a repeated batch has the same days and replaces what it wrote before."""
        own = rows.withColumn("batch", F.lit(batch_id).cast("bigint")).select(self.schema.names)
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day, "batch").parquet(self.root)

    def days(self, wanted: Iterable[str], before: int) -> DataFrame:
        """Rows of these days that batches before `before` have written."""
        paths = [f"{self.root}/{self.day}={d}" for d in sorted(set(wanted))]
        paths = [p for p in paths if self._files.exists(self._hadoop(p))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.option("basePath", self.root).schema(self.schema).parquet(*paths).where(F.col("batch") < before)
