"""Tables typed by people, chat exports, folders of media and the message feed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline import constants as K
from proofline.functions.text import extension, strip
from proofline.session import scratch

MEDIA_EXTENSIONS = (*K.IMAGE_EXTENSIONS, *K.VIDEO_EXTENSIONS)

# fixed values: the two line shapes of a chat export
LINE_DASH = r"^(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2}(?::\d{2})?)\s*-\s*([^:]+):\s*(.*)$"
LINE_BRACKET = r"^\[(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2}(?::\d{2})?)\]\s*([^:]+):\s*(.*)$"
DIRECTION_MARKS = "‎‏"


def _numbered(df: DataFrame, first: int) -> DataFrame:
    """Adds row_number in file order, counting from `first` in each file. Runs a job.

    The source is scanned once: rows are written with the block they were read
    in and their place there, and numbered from the written table, so that no
    second scan has to be split alike. Rows are neither sorted nor shuffled;
    only one row per block is.
    """
    spark = df.sparkSession
    path = scratch(spark, "numbered")
    kept = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)],
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    kept.write.parquet(path)
    rows = spark.read.schema(kept.schema).parquet(path)
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("start"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(blocks, ["file", "block"]).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)],
        (F.col("id") - F.col("start") + F.col("skip") + first).alias("row_number"),
    )


def read_tabular(
    spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None,
    sep: str = ",", multi_line: bool = False,
) -> DataFrame:
    """A CSV with header: every column as text, empty cells empty, row_number from 2.

    `mapping` (field -> column) is only checked here; `import_ledger` applies it.
    """
    df = spark.read.csv(
        path, header=True, inferSchema=False, sep=sep, escape='"', multiLine=multi_line, enforceSchema=False
    )
    missing = [c for c in (mapping or {}).values() if c and c not in df.columns]
    if mapping and mapping.get("group_id") in missing:
        raise ValueError(f"columns not in the file: {missing}")
    return _numbered(df, 2).na.fill("", [c for c in df.columns])


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first `n` rows of a table read by `read_tabular`."""
    return df.orderBy("row_number").limit(n)


def _instant(date: Column, time: Column) -> Column:
    """Day first when that is a date, else month first; two-digit years from 69 are 19xx."""
    def part(n: int) -> Column:
        return F.lpad(F.split_part(date, F.lit("/"), F.lit(n)), 2, "0")

    tail = F.split_part(date, F.lit("/"), F.lit(3))
    year = F.when(F.length(tail) == 4, tail).when(
        F.length(tail) == 2, F.concat(F.when(tail >= "69", "19").otherwise("20"), tail)
    )
    clock = F.concat(
        F.lpad(F.split_part(time, F.lit(":"), F.lit(1)), 2, "0"), F.lit(":"),
        F.split_part(time, F.lit(":"), F.lit(2)), F.lit(":"),
        F.coalesce(F.nullif(F.split_part(time, F.lit(":"), F.lit(3)), F.lit("")), F.lit("00")),
    )

    def stamp(month: Column, day: Column) -> Column:
        text = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock)
        return text.try_cast("timestamp_ntz")

    return F.coalesce(stamp(part(2), part(1)), stamp(part(1), part(2)))


def parse_chat_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(sent_at, sender, text, media_filename) of each line that is a message; others are dropped."""
    clean = strip(F.translate(F.col(column), DIRECTION_MARKS, ""))
    rows = lines.withColumn("__line", clean)
    shape = F.when(F.col("__line").rlike(LINE_DASH), 1).when(F.col("__line").rlike(LINE_BRACKET), 2)
    rows = rows.withColumn("__shape", shape).where("__shape IS NOT NULL")

    def group(n: int) -> Column:
        return F.when(F.col("__shape") == 1, F.regexp_extract("__line", LINE_DASH, n)).otherwise(
            F.regexp_extract("__line", LINE_BRACKET, n)
        )

    text = strip(group(4))
    named = F.regexp_extract(text, K.MEDIA_NAME, 1)
    marked = F.lower(text).rlike("|".join(K.ATTACHMENT_WORDS))
    media = F.when(named != "", named).when(marked, K.UNNAMED_ATTACHMENT)
    kept = [c for c in lines.columns if c != column]
    return rows.select(
        *kept, _instant(group(1), group(2)).alias("sent_at"), strip(group(3)).alias("sender"),
        text.alias("text"), media.alias("media_filename"),
    )


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a chat text export."""
    return parse_chat_lines(spark.read.text(path))


def file_manifest(spark: SparkSession, directory: str, exts: Iterable[str] = MEDIA_EXTENSIONS) -> DataFrame:
    """(path, name, ext, size) of the files below a folder with one of the extensions.

    Only file listings are read: the content column is never touched.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return _manifest(files, exts)


def _manifest(files: DataFrame, exts: Iterable[str]) -> DataFrame:
    ext = extension(F.col("path"))
    return files.where(ext.isin(*exts)).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), ext.alias("ext"),
        F.col("length").alias("size"),
    )


BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def incremental_files(
    spark: SparkSession, directory: str, exts: Iterable[str] = MEDIA_EXTENSIONS
) -> DataFrame:
    """The manifest as a stream: each file once, across runs of one checkpoint."""
    files = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option(
        "recursiveFileLookup", "true"
    ).load(directory)
    return _manifest(files, exts)


def read_messages(
    spark: SparkSession, directory: str, streaming: bool = False, pattern: str = "*.parquet"
) -> DataFrame:
    """The message feed, at rest or as a stream over new files."""
    if not streaming:
        return spark.read.option("pathGlobFilter", pattern).parquet(directory)
    schema = spark.read.option("pathGlobFilter", pattern).parquet(directory).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(directory)


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """First column of an id list; the separator is `;` if the first line has one, else `,`."""
    lines = spark.read.text(path)
    head = lines.limit(1).collect()
    sep = ";" if head and ";" in head[0][0] else ","
    table = spark.read.csv(path, header=False, inferSchema=False, sep=sep, escape='"')
    return table.select(F.regexp_replace(F.col(table.columns[0]), "^\\uFEFF", "").alias("business_id"))
