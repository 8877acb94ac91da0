"""Upkeep of follow-up cases over a stream of proofs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.operators.cases import rebuild_cases
from proofline.operators.identity import KEY, has_report_key
from proofline.streaming.days import NO_DAY, DayTable, day_of, days_of


def _kept(rows: DataFrame, root: str, name: str, batch_id: int) -> DataFrame:
    """Writes rows of a batch under its id and reads them back: whatever follows starts from here."""
    path = f"{root}/{name}/batch={batch_id}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _newest(rows: DataFrame, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """For each key the row of its newest batch, within a batch the one with the largest `version`; ties go by the row's values."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    best = F.max_by(F.struct(*values), F.struct("batch", *version, *values)).alias("v")
    return rows.groupBy(*keys).agg(best).select(*keys, "v.*")


def _only(rows: DataFrame, ids: DataFrame, column: str = "evidence_id") -> DataFrame:
    """Rows whose id is among the ids, which are in the first column."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def case_state_sink(
    root: str, cases: DataFrame, now: dt.datetime | str, version: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """Batch function: upkeep of cases, right for proofs that finish out of order.

    Only reports a batch touches are rebuilt: their submissions so far, latest version each, and their cases. What has
    been met lies in folders by day, and a batch reads the days it touches: versions of a submission by the day of its
    reception, which never changes; submissions of a report by the report's day; cases by the reception of their proof;
    the cases that a submission settles by its reception. So a batch costs what its days hold, however long the stream
    has run.

    `version` names the columns that tell two versions of a submission in one batch apart (a time of change). `cases`
    are those from before the stream; they are read with every batch. Writes `<root>/cases`, where the newest row of a
    case holds, and the tables it keeps.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        facts = list(batch.schema.fields)
        ident = next(f for f in facts if f.name == "evidence_id")
        text = lambda name: T.StructField(name, T.StringType())
        versions = DayTable(spark, f"{root}/versions", facts, "seen_day")
        reports = DayTable(spark, f"{root}/reports", [*facts, text("seen_day"), T.StructField("gone", T.BooleanType())], "report_day")
        reference = [T.StructField("case_evidence_id", ident.dataType), *[text(c) for c in (*KEY, "seen_day")]]
        settles = DayTable(spark, f"{root}/settles", [T.StructField("evidence_id", ident.dataType), *reference], "settled_day")

        # The batch's submissions, and the report that a former version of one belonged to.
        placed = batch.withColumns({"seen_day": day_of(F.col("received_at")), "batch": F.lit(batch_id).cast("bigint")})
        own = _kept(_newest(placed, ["evidence_id"], version), root, "own", batch_id)
        seen = days_of((own, "seen_day"))
        former = _newest(_only(versions.days(seen, batch_id), own), ["evidence_id"], version)
        other = reduce(lambda a, b: a | b, [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in KEY])
        moved = former.alias("o").join(own.alias("n"), "evidence_id").where(other).select("evidence_id", *[
            F.col(f"o.{c}") for c in own.columns if c != "evidence_id"
        ])
        entries = own.withColumn("gone", F.lit(False)).unionByName(moved.withColumn("gone", F.lit(True)))
        entries = _kept(entries.withColumn("report_day", day_of(F.col("sync_date"))), root, "entries", batch_id)
        versions.put(own, batch_id)
        reports.put(entries.where(has_report_key()), batch_id)

        # Submissions that cases from before the stream name, as proof or as replacement: no more than those cases.
        named = cases.select(F.col("case_evidence_id").alias("evidence_id")).unionByName(
            cases.select(F.col("replacement_evidence_id").alias("evidence_id"))
        ).where("evidence_id IS NOT NULL")
        _kept(_only(own, named), root, "named", batch_id)
        every = spark.read.option("basePath", f"{root}/named").schema(
            T.StructType([*own.schema.fields, T.StructField("batch", T.LongType())])
        ).parquet(f"{root}/named").where(F.col("batch") <= batch_id)
        known = _newest(every, ["evidence_id"], version)

        # Cases whose replacement has changed, with the report their proof belongs to.
        links = cases.where("replacement_evidence_id IS NOT NULL").select("case_evidence_id", F.col("replacement_evidence_id").alias("evidence_id"))
        place = [F.col(c).cast("string").alias(c) for c in KEY] + [F.col("seen_day")]
        hits = _only(links, own).select("case_evidence_id").join(
            known.select(F.col("evidence_id").alias("case_evidence_id"), *place), "case_evidence_id", "left"
        ).unionByName(_only(settles.days(seen, batch_id), own).select(*[f.name for f in reference]))
        hits = _kept(hits.distinct().withColumn("report_day", day_of(F.col("sync_date"))), root, "hits", batch_id)

        # The reports touched, whole; submissions without a whole key stand alone.
        keys = entries.select(*[F.col(c).cast("string").alias(c) for c in KEY]).unionByName(hits.select(*KEY)).dropna().distinct()
        held = reports.days(days_of((entries, "report_day"), (hits, "report_day")), batch_id + 1)
        same_key = reduce(lambda a, b: a & b, [F.col(f"r.{c}").cast("string") == F.col(f"k.{c}") for c in KEY])
        members = _newest(held.alias("r").join(keys.alias("k"), same_key, "left_semi").drop("report_day"), ["evidence_id", *KEY], version)
        alone = own.where(~has_report_key()).unionByName(_newest(
            _only(versions.days(days_of((hits, "seen_day")), batch_id), hits), ["evidence_id"], version
        ).join(own.select("evidence_id"), "evidence_id", "left_anti"))
        members = members.where("NOT gone").select(own.columns).unionByName(alone.where(~has_report_key()))
        subset = _kept(members, root, "subset", batch_id)

        # Their cases as they stand, and the replacements those name.
        state = [*[f for f in cases.schema.fields if f.name != "case_evidence_id"]]
        for name, kind in (("reason", T.StringType()), ("resolved_at", T.TimestampNTZType())):
            state += [T.StructField(name, kind)] if name not in cases.columns else []
        standing = DayTable(spark, f"{root}/cases", [T.StructField("case_evidence_id", ident.dataType), *state, text("settled_day")], "case_day")
        wanted = subset.select("evidence_id").unionByName(hits.select(F.col("case_evidence_id").alias("evidence_id")))
        newer = _newest(_only(standing.days([*days_of((subset, "seen_day"), (hits, "seen_day")), NO_DAY], batch_id), wanted, "case_evidence_id"), ["case_evidence_id"])
        prior = _only(cases, wanted, "case_evidence_id").join(newer.select("case_evidence_id"), "case_evidence_id", "left_anti")
        prior = _kept(prior.unionByName(newer.drop("case_day"), allowMissingColumns=True), root, "prior", batch_id)
        needed = prior.select(F.col("replacement_evidence_id").alias("evidence_id")).where("evidence_id IS NOT NULL")
        apart = _newest(
            _only(versions.days(days_of((prior, "settled_day")), batch_id + 1), needed), ["evidence_id"], version
        ).unionByName(_only(known, needed).select(own.columns))
        extra = apart.dropDuplicates(["evidence_id"]).join(subset.select("evidence_id"), "evidence_id", "left_anti")
        # Replacements join the subset only to be judged; their own reports are untouched.
        extra = _kept(extra, root, "extra", batch_id)

        rows = subset.unionByName(extra)
        rebuilt = rebuild_cases(prior, rows, now).join(
            extra.select(F.col("evidence_id").alias("case_evidence_id")), "case_evidence_id", "left_anti"
        )
        days = rows.select("evidence_id", "seen_day")
        proofs = rows.select(F.col("evidence_id").alias("case_evidence_id"), *place)
        rebuilt = rebuilt.join(proofs, "case_evidence_id", "left").join(
            days.select(F.col("evidence_id").alias("replacement_evidence_id"), F.col("seen_day").alias("settled_day")), "replacement_evidence_id", "left"
        )
        rebuilt = _kept(rebuilt.withColumn("case_day", F.coalesce("seen_day", F.lit(NO_DAY))), root, "rebuilt", batch_id)
        standing.put(rebuilt, batch_id)
        settles.put(rebuilt.where("settled_day IS NOT NULL AND replacement_evidence_id <> case_evidence_id").withColumn(
            "evidence_id", F.col("replacement_evidence_id")
        ), batch_id)

    return process
