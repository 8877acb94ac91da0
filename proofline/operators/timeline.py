"""As-of matching along time, split so that no key has to fit one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_forward_match(
    originals: DataFrame, usable: DataFrame, key: Sequence[str],
    time: str = "received_at", ident: str = "evidence_id", slot: str = "minute", fine: str = "millisecond",
) -> DataFrame:
    """(evidence_id, replacement_id): first usable row of the key at or after each original.

    Equal times are broken by the lowest id. Originals without a match are left
    out, as are rows without a time or a part of the key.

    Rows shrink to one for each key and instant before anything is ordered, so
    rows of one instant cost nothing. Instants are read backward within a
    fine slot, fine slots within a slot and slots within a key: no task holds more
    than the instants of a fine slot, the fine slots of a slot or a key's slots.
    """
    key = list(key)
    complete = F.col(time).isNotNull()
    for name in key:
        complete = complete & F.col(name).isNotNull()
    kind = usable.schema[ident].dataType

    def timed(df: DataFrame, hit: Column) -> DataFrame:
        return df.where(complete).select(*key, F.col(time).alias("__t"), hit.cast(kind).alias("__id"))

    line = timed(originals, F.lit(None)).unionByName(timed(usable, F.col(ident)))
    line = line.groupBy(*key, "__t").agg(F.min("__id").alias("__id")).withColumns({
        "__slot": F.date_trunc(slot, "__t"), "__fine": F.date_trunc(fine, "__t"),
    })
    cell = [*key, "__slot", "__fine"]
    near = Window.partitionBy(*cell).orderBy(F.col("__t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("__near", F.last("__id", ignorenulls=True).over(near))

    fines = line.groupBy(*cell).agg(F.min(F.when(F.col("__id").isNotNull(), F.struct("__t", "__id"))).alias("__first"))
    slots = fines.groupBy(*key, "__slot").agg(F.min("__first").alias("__first"))
    fines, slots = (
        table.withColumn("__next", F.last("__first.__id", ignorenulls=True).over(
            Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
        )).drop("__first")
        for table, by, order in ((fines, [*key, "__slot"], "__fine"), (slots, key, "__slot"))
    )
    fines = fines.join(slots.withColumnRenamed("__next", "__far"), [*key, "__slot"], "left")
    found = line.join(fines, cell, "left").select(
        *key, "__t", F.coalesce("__near", "__next", "__far").alias("replacement_id")
    ).where("replacement_id IS NOT NULL")
    asked = originals.where(complete).select(*key, F.col(time).alias("__t"), ident)
    return asked.join(found, [*key, "__t"]).select(ident, "replacement_id")
