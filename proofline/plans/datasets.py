"""One query model over three datasets: evidence, followups, coverage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.operators import cases as C
from proofline.operators import coverage as V
from proofline.operators import identity as I
from proofline.operators import stats as S


class ScopeError(ValueError):
    """The query asks for more than its guard allows."""


@dataclass(frozen=True)
class OperationQuery:
    dataset: str
    start: dt.date
    end: dt.date
    scope: str = "selected"
    cadence: str = "daily"
    application: str = ""
    agent: str = ""
    group: str = ""
    locality: str = ""
    evidence_id: object = None
    status: str = ""


def scope_problem(dataset: Column, scope: Column, start: Column, end: Column, max_days: int | None = None) -> Column:
    """Why a query cannot be answered as asked, or null: coverage without a period, days out of order, and, only if the
    caller sets `max_days`, a period that is longer."""
    days = F.datediff(end, start) + 1
    problem = F.when((dataset == "coverage") & (scope == "all"), K.SCOPE_NEEDS_PERIOD).when(days < 1, K.SCOPE_OUT_OF_ORDER)
    return problem if max_days is None else problem.when(days > max_days, K.SCOPE_TOO_LONG)


def scope_guard(q: OperationQuery, max_days: int | None = None) -> None:
    """Raises for a query that cannot be answered as asked (see `scope_problem`). It neither runs a job nor cuts."""
    if q.dataset == "coverage" and q.scope == "all":
        raise ScopeError(K.SCOPE_NEEDS_PERIOD)
    if q.end < q.start:
        raise ScopeError(K.SCOPE_OUT_OF_ORDER)
    if max_days is not None and (q.end - q.start).days + 1 > max_days:
        raise ScopeError(K.SCOPE_TOO_LONG)


def operational_filter(view: DataFrame, q: OperationQuery) -> DataFrame:
    """Case-insensitive substrings, exact id, and status with its two aliases."""
    rows = view
    for name in ("application", "agent", "group", "locality"):
        wanted = getattr(q, name)
        if wanted:
            rows = rows.where(F.lower(F.coalesce(F.col(name), F.lit(""))).contains(wanted.lower()))
    if q.evidence_id is not None:
        rows = rows.where(F.col("evidence_id") == q.evidence_id)
    if q.status == "TO_REVIEW" and "processing_status" in view.columns:
        rows = rows.where((F.col("status") == q.status) | (F.col("processing_status") == "REQUIRES_REVIEW"))
    elif q.status == "NOT_VALIDATED":
        rows = rows.where(F.col("status").isin("NOT_VALIDATED", "REVIEW", "FAILED", "UNCONFIRMED"))
    elif q.status:
        rows = rows.where(F.col("status") == q.status)
    return rows


def _view(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The base view: tables["view"] when the caller has stored one, else planned afresh."""
    if "view" in tables:
        return tables["view"]
    return I.evidence_view(
        tables["submissions"], tables["messages"], tables["agents"], tables["applications"]
    )


def _in_scope(view: DataFrame, q: OperationQuery) -> DataFrame:
    if q.scope == "all":
        return view
    return view.where(F.col("date").between(q.start.isoformat(), q.end.isoformat()))


def evidence_dataset(tables: Mapping[str, DataFrame], q: OperationQuery, max_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, totals) of the submissions in scope. A limit on days holds only if the caller sets one."""
    scope_guard(q, max_days)
    view = _in_scope(_view(tables), q)
    rows = operational_filter(view, q)
    return rows, S.operational_totals(rows, view)


def followup_dataset(tables: Mapping[str, DataFrame], q: OperationQuery, max_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Case groups of the submissions in scope, with the attributes of the leading one."""
    scope_guard(q, max_days)
    view = _in_scope(_view(tables), q)
    # The view already carries everything a report key needs.
    proofs = view.select(
        "evidence_id", "received_at", "sender_identity", "application_id", F.col("group").alias("group_id"),
        F.col("detected_date").alias("sync_date"), "date_is_ambiguous", "duplicate_of_id",
    )
    groups = C.followup_rows(tables["cases"], proofs, tables["attempts"])
    attributes = view.drop("status", "received_at", "duplicate_of_id")
    rows = groups.join(
        attributes.withColumnRenamed("evidence_id", "case_evidence_id"), "case_evidence_id"
    ).withColumn("evidence_id", F.col("case_evidence_id"))
    rows = operational_filter(rows, q)
    return rows, S.operational_totals(rows, view)


def coverage_dataset(tables: Mapping[str, DataFrame], q: OperationQuery, max_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The participant calendar, whatever its size."""
    scope_guard(q, max_days)
    view = _view(tables)
    rows = operational_filter(V.coverage(view, tables["ledger"], q.start, q.end, q.cadence), q)
    return rows, S.operational_totals(rows, _in_scope(view, q))
