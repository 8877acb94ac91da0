"""Report dates read from noisy French or English text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.text import let

DATE_PATTERN = K.DATE_PATTERN


def _tidy(piece: Column) -> Column:
    trimmed = F.regexp_replace(piece, r"^[\s,]+|[\s,]+$", "")
    return F.regexp_replace(F.translate(trimmed, ",", " "), r"\s{2,}", " ")


def find_date_candidates(text: Column) -> Column:
    """Every date-like piece of a text, in order, without commas."""
    return F.transform(F.regexp_extract_all(text, F.lit(DATE_PATTERN), 1), _tidy)


def _month_number(word: Column) -> Column:
    number = F.lit(None).cast("int")
    for month in range(12, 0, -1):
        words = [w for w, n in K.MONTH_NUMBER.items() if n == month]
        number = F.when(word.isin(*words), month).otherwise(number)
    return number


def parse_report_date(text: Column, context: Column | None = None) -> Column:
    """struct(raw_text, normalized_date, is_ambiguous, missing_year, confidence, note).

    Numeric dates are read day first. A piece without a year starting 19 or 20
    has no year: it takes the year of `context` and stays ambiguous, or yields
    nothing when there is no context. Impossible dates yield nothing.
    """
    first = F.regexp_extract(text, DATE_PATTERN, 1)
    context_day = (context if context is not None else F.lit(None)).cast("date")
    return let(
        F.struct(F.when(first != "", _tidy(first)).alias("raw"), context_day.alias("day")),
        lambda v: _read_date(v["raw"], v["day"]),
    )


def _read_date(raw: Column, context_day: Column) -> Column:
    has_year = raw.rlike(r"(19|20)\d{2}")

    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    numeric = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})$"
    worded = r"^(\d{1,2})\s*([^\d\s.]+)\.?\s*(\d{0,4})$"

    def part(order: tuple[int, int, int]) -> Column:
        return (
            F.when(raw.rlike(iso), F.regexp_extract(raw, iso, order[0]))
            .when(raw.rlike(numeric), F.regexp_extract(raw, numeric, order[1]))
            .when(raw.rlike(worded), F.regexp_extract(raw, worded, order[2]))
        )

    day = part((3, 1, 1))
    month = F.coalesce(
        part((2, 2, 2)).try_cast("int"),
        _month_number(F.lower(part((2, 2, 2)))),
    )
    year = F.when(has_year, part((1, 3, 3))).otherwise(F.year(context_day).cast("string"))
    parsed = F.concat(
        year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0")
    ).try_cast("date")
    return let(
        F.when(has_year | context_day.isNotNull(), parsed),
        lambda normalized: _date_outcome(raw, normalized, has_year, context_day),
    )


def _date_outcome(raw: Column, normalized: Column, has_year: Column, context_day: Column) -> Column:
    return F.struct(
        raw.alias("raw_text"),
        normalized.cast("string").alias("normalized_date"),
        (normalized.isNull() | ~has_year).alias("is_ambiguous"),
        F.coalesce(~has_year, F.lit(False)).alias("missing_year"),
        F.when(normalized.isNull(), 0.0).when(has_year, 0.9).otherwise(0.6).alias("confidence"),
        F.when(raw.isNull(), K.REVIEW_NO_DATE)
        .when(~has_year & context_day.isNull(), K.REVIEW_NO_YEAR)
        .when(normalized.isNull(), K.REVIEW_BAD_DATE)
        .when(~has_year, K.REVIEW_DEDUCED_YEAR).alias("note"),
    )
