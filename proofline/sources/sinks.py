"""Writers: spreadsheet-safe CSV and one folder per report sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.functions.text import safe_cell


def safe_columns(df: DataFrame) -> DataFrame:
    """Every column as text a spreadsheet shows and never runs; nested values as JSON."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.coalesce(F.to_json(column), F.lit(""))
        elif isinstance(field.dataType, T.StringType):
            column = safe_cell(column)
        else:
            column = F.coalesce(column.cast("string"), F.lit(""))
        out.append(column.alias(field.name))
    return df.select(*out)


def safe_csv_sink(df: DataFrame, path: str, sep: str = ";") -> None:
    """Writes a CSV with header. Runs the job."""
    safe_columns(df).write.mode("overwrite").csv(path, header=True, sep=sep, escape='"', emptyValue="")


def write_report(sheets: DataFrame, path: str) -> None:
    """One folder per sheet. Runs the job."""
    sheets.write.mode("overwrite").partitionBy("sheet").parquet(path)
