"""The reconciliation report as one table with a sheet column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.operators.stats import status_share


def report_sheets(results: DataFrame, submissions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Nine result sheets, a summary, both raw sides and the corrections.

    Columns a sheet does not use are null; `sinks.write_report` stores a folder per sheet.
    """
    names = F.create_map(*[F.lit(x) for pair in K.SHEET_OF_STATUS.items() for x in pair])
    shown = results.select(
        names[F.col("status")].alias("sheet"), "status", "whatsapp_group_id", "dashboard_group_id",
        "whatsapp_date", "dashboard_date", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "locality", "evidence_id", "row_id",
    )
    summary = status_share(results).select(F.lit(K.SHEET_SUMMARY).alias("sheet"), "status", "n", "percent")
    claims = submissions.select(
        F.lit(K.SHEET_RAW_CLAIMS).alias("sheet"), F.col("sync_status").alias("status"),
        F.col("normalized_group_id").alias("whatsapp_group_id"),
        F.col("normalized_date").alias("whatsapp_date"), "confidence", "evidence_id",
    )
    rows = ledger.select(
        F.lit(K.SHEET_RAW_LEDGER).alias("sheet"), F.when(F.col("is_valid"), "Oui").otherwise("Non").alias("status"),
        F.col("group_id").alias("dashboard_group_id"), F.col("sync_date").alias("dashboard_date"), "row_id",
    )
    corrected = (F.coalesce("corrected_group_id", F.lit("")) != "") | (
        F.coalesce("corrected_date", F.lit("")) != ""
    )
    corrections = submissions.where(corrected).select(
        F.lit(K.SHEET_CORRECTIONS).alias("sheet"), F.col("normalized_group_id").alias("whatsapp_group_id"),
        F.col("normalized_date").alias("whatsapp_date"), "corrected_group_id", "corrected_date", "evidence_id",
    )
    sheets = shown
    for part in (summary, claims, rows, corrections):
        sheets = sheets.unionByName(part, allowMissingColumns=True)
    return sheets
