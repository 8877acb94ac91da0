"""Who reported on which day: observed participants against a calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.joins import first_by, split_join
from proofline.functions.text import present

PARTICIPANT = ["sender_identity", "application_id", "group"]
ATTRIBUTES = ["agent_id", "agent", "locality", "application"]


def priority(status: Column | None = None) -> Column:
    column = F.col("status") if status is None else status
    order = F.create_map(*[F.lit(x) for i, s in enumerate(K.COVERAGE_PRIORITY) for x in (s, i)])
    return F.try_element_at(order, column)


def _participating() -> Column:
    known = F.col("status") != "DUPLICATE"
    for name in PARTICIPANT:
        known = known & present(F.col(name).cast("string"))
    return known


def _seen_until(until: dt.date | str) -> Column:
    return F.to_date("received_at") <= F.lit(str(until)).cast("date")


def first_observation(view: DataFrame, until: dt.date | str) -> DataFrame:
    """One row per participant, with the attributes of its first submission up to `until`."""
    seen = view.where(_participating() & _seen_until(until))
    return first_by(seen, PARTICIPANT, ["received_at", "evidence_id"], ATTRIBUTES)


def _best_first() -> Column:
    return F.struct(priority().alias("p"), F.col("received_at").alias("r"), F.col("evidence_id").alias("e"))


def best_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Best submission per key by status priority, then reception, then id; with the number of rows."""
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct("status", "evidence_id", F.col("date").alias("best_date")), _best_first()).alias("best"),
        F.count("*").alias("submission_count"),
    ).select(*keys, "best.*", "submission_count")


def ledger_presence(best: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds dashboard_present: the best date stands in a valid, non-repeated ledger row of a finished import."""
    rows = ledger.where("is_valid")
    if "is_duplicate" in ledger.columns:
        rows = rows.where(~F.col("is_duplicate"))
    if "import_status" in ledger.columns:
        rows = rows.where(F.col("import_status") == "COMPLETED")
    days = rows.select(
        "application_id", F.col("group_id").alias("group"), F.col("sync_date").alias("best_date"),
        F.lit(True).alias("dashboard_present"),
    ).distinct()
    return split_join(best, days, ["application_id", "group", "best_date"]).withColumn(
        "dashboard_present", F.coalesce("dashboard_present", F.lit(False))
    )


def coverage(
    view: DataFrame, ledger: DataFrame, start: dt.date | str, end: dt.date | str, cadence: str = "daily"
) -> DataFrame:
    """One row per observed participant and day (or whole period): best status or MISSING."""
    first, last = str(start), str(end)
    counted = (F.col("date_basis") == "report_date") & F.col("date").between(first, last)
    if cadence == "daily":
        own_day, period_end, length = F.col("date"), F.col("day"), F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    else:
        own_day, period_end, length = F.lit(first), F.lit(last), F.lit(1)

    # One pass over the view: first to one row per participant and day, then to one per
    # participant with its days, of which there are no more than the calendar has.
    order = F.when(_seen_until(last), F.struct("received_at", "evidence_id"))
    best = F.struct("status", "evidence_id", F.col("date").alias("best_date"))
    per_day = view.where(_participating()).groupBy(*PARTICIPANT, F.when(counted, own_day).alias("day")).agg(
        F.min(order).alias("first_at"), F.min_by(F.struct(*ATTRIBUTES), order).alias("attributes"),
        F.min_by(best, F.when(counted, _best_first())).alias("best"), F.count_if(counted).alias("submission_count"),
    )
    place = F.datediff(F.col("day").try_cast("date"), F.lit(first).cast("date"))
    observed = F.when(place.isNotNull(), F.struct(place.alias("place"), F.struct("best.*", "submission_count").alias("f")))
    people = per_day.groupBy(*PARTICIPANT).agg(
        F.min("first_at").alias("first_at"), F.min_by("attributes", "first_at").alias("attributes"),
        F.array_sort(F.collect_list(observed)).alias("found"),
    ).where("first_at IS NOT NULL")

    # Observed days split the calendar into stretches without any: each is unfolded behind the day it follows, the first
    # one at the beginning. So the cells come out in order and no day is looked up.
    def missing(begin: Column, end: Column) -> Column:
        days = F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(days, lambda d: F.struct(d.alias("place"), F.lit(None).cast(people.schema["found"].dataType.elementType["f"].dataType).alias("f")))

    def stretch(seen: Column, i: Column) -> Column:
        following = F.coalesce(F.try_element_at("found", i + 2)["place"], length)
        return F.concat(F.array(seen), missing(seen["place"] + 1, following))

    start_of = F.coalesce(F.try_element_at("found", F.lit(1))["place"], length)
    cells = F.concat(missing(F.lit(0), start_of), F.flatten(F.transform("found", stretch)))
    grid = people.select(*PARTICIPANT, "attributes.*", "found", F.explode(cells).alias("cell")).select(
        *PARTICIPANT, *ATTRIBUTES, F.date_add(F.lit(first).cast("date"), F.col("cell.place")).cast("string").alias("day"), "cell.f.*"
    )
    return ledger_presence(grid, ledger).select(
        "sender_identity", "agent_id", "agent", "locality", "application_id", "application", "group",
        F.col("day").alias("date"), period_end.alias("period_end"),
        F.coalesce("status", F.lit("MISSING")).alias("status"), "evidence_id",
        F.coalesce("submission_count", F.lit(0)).alias("submission_count"), "dashboard_present",
    )
