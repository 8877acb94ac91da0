"""Imports of tables typed by people: ledger rows, expected ids, agents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.dates import parse_report_date
from proofline.functions.ids import normalize_id, validation_errors
from proofline.functions.joins import first_by, lookup
from proofline.functions.text import business_key, non_empty, strip

FIELDS = ("group_id", "declared_group_id", "sync_date", "agent", "locality", "status")


def import_dups(rows: DataFrame) -> DataFrame:
    """Adds is_duplicate: an earlier row of the import has the same normalized id, valid or not."""
    first = first_by(
        rows.where("normalized_group_id IS NOT NULL"), ["normalized_group_id"], ["row_number"], ["row_number"]
    ).withColumnRenamed("row_number", "first_row")
    return lookup(rows, first, "normalized_group_id", "row_number").withColumn(
        "is_duplicate", F.coalesce(F.col("row_number") > F.col("first_row"), F.lit(False))
    ).drop("first_row")


def read_rows(rows: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Mapped columns normalised and checked; unmapped ones kept in extra_fields."""
    if not mapping.get("group_id"):
        raise ValueError("the mapping must name the group id column")

    def cell(field: str):
        column = mapping.get(field)
        if not column or column not in rows.columns:
            return F.lit(None).cast("string")
        return strip(F.coalesce(F.col(column).cast("string"), F.lit("")))

    used = {c for c in mapping.values() if c} | {"row_number"}
    rest = [c for c in rows.columns if c not in used]
    extra = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else (
        F.lit(None).cast("map<string,string>")
    )
    has_dates = mapping.get("sync_date") in rows.columns
    typed = rows.select(
        "row_number", cell("group_id").alias("raw_id"), cell("sync_date").alias("raw_date"),
        cell("declared_group_id").alias("declared"), cell("agent").alias("agent"),
        cell("locality").alias("locality"), cell("status").alias("status_raw"), extra.alias("extra_fields"),
    ).withColumns({
        "normalized_group_id": normalize_id(F.col("raw_id"))["normalized"],
        "sync_date": parse_report_date(F.col("raw_date"))["normalized_date"],
    })
    # Without a date column there is nothing to complain about.
    raw_date = F.col("raw_date") if has_dates else F.lit("-")
    date = F.col("sync_date") if has_dates else F.lit("-")
    errors = validation_errors(F.col("raw_id"), F.col("normalized_group_id"), raw_date, date)
    return typed.select(
        "row_number", non_empty(F.col("raw_id")).alias("raw_group_id"), "normalized_group_id",
        non_empty(F.col("declared")).alias("declared_group_id"),
        non_empty(F.col("raw_date")).alias("sync_date_raw"), "sync_date",
        non_empty(F.col("agent")).alias("agent"), non_empty(F.col("locality")).alias("locality"),
        non_empty(F.col("status_raw")).alias("status_raw"), "extra_fields",
        errors.alias("validation_errors"), (F.size(errors) == 0).alias("is_valid"),
    )


def import_totals(rows: DataFrame) -> DataFrame:
    """One row: total, imported, rejected, duplicates."""
    return rows.agg(
        F.count("*").alias("total_rows"), F.count_if("is_valid").alias("imported_rows"),
        F.count_if(~F.col("is_valid")).alias("rejected_rows"), F.count_if("is_duplicate").alias("duplicate_rows"),
    )


def error_report(rows: DataFrame) -> DataFrame:
    """Every rejected row with its errors."""
    return rows.where(~F.col("is_valid")).select("row_number", "raw_group_id", "validation_errors")


def import_ledger(rows: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(every row with its errors and duplicate mark, totals). Invalid rows are kept."""
    done = import_dups(read_rows(rows, mapping))
    return done, import_totals(done)


def import_expected(
    ids: DataFrame, existing: DataFrame, project: object, app: str
) -> tuple[DataFrame, DataFrame]:
    """(ids to add, ids already present) for one project and application.

    `ids` has one text column. Ids are trimmed and lower-cased, header words and
    blanks removed, repeats merged.
    """
    value = ids.columns[0]
    keys = ids.select(business_key(F.col(value)).alias("business_id")).where(
        (F.col("business_id") != "") & ~F.col("business_id").isin(*K.EXPECTED_HEADER_WORDS)
    ).distinct()
    known = existing.where((F.col("project_id") == project) & (F.col("application_id") == app)).select(
        "business_id"
    ).distinct()
    return keys.join(known, "business_id", "left_anti"), keys.join(known, "business_id", "left_semi")


def agent_columns(columns: list[str]) -> dict[str, str | None]:
    """The name, phone and locality columns, by words in their headers; the first fit wins."""
    lowered = [(c.lower().strip(), c) for c in columns]

    def pick(*words: str) -> str | None:
        return next((c for low, c in lowered if any(w in low for w in words)), None)

    return {
        "name": pick("nom", "name"),
        "phone": pick("phone", "tel", "whatsapp"),
        "locality": pick("localite", "locality", "zone"),
    }


def import_agents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agents, rejected rows). `row_number` counts from the header line as 1."""
    columns = agent_columns([c for c in rows.columns if c != "row_number"])
    if columns["name"] is None:
        raise ValueError("no column for the agent's name")

    def cell(field: str):
        column = columns[field]
        return F.lit(None).cast("string") if column is None else strip(F.col(column).cast("string"))

    typed = rows.select(
        "row_number", cell("name").alias("full_name"), cell("phone").alias("phone"),
        cell("locality").alias("locality"),
    )
    named = F.coalesce(F.col("full_name") != "", F.lit(False))
    rejects = typed.where(~named).select(
        "row_number", F.concat(F.lit("Ligne "), F.col("row_number"), F.lit(": nom manquant")).alias("error")
    )
    return typed.where(named), rejects
