"""Group ids read from noisy text: `gr<number>.<slug>`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.text import compat_text, has_text, let, non_empty, strip


def find_id_candidates(text: Column) -> Column:
    """Pieces of a text that look like a group id, in order.

    A date standing next to an id is cut off first, and a piece ends with its line.
    """
    undated = F.regexp_replace(text, rf"(?<!\S){K.STANDALONE_DATE}(?=\s|$)", "\n")
    hits = F.regexp_extract_all(undated, F.lit(f"(?i)({K.ID_CANDIDATE})"), 1)
    first_lines = F.transform(hits, lambda hit: F.regexp_extract(strip(hit), r"^([^\n\r]*)", 1))
    return F.filter(first_lines, lambda piece: piece != "")


def normalize_id(raw: Column) -> Column:
    """struct(normalized, valid, corrections, confidence) of one raw id."""
    cleaned = F.translate(strip(compat_text(raw)), K.DASH_CHARS, "-" * len(K.DASH_CHARS))
    cleaned = F.regexp_replace(cleaned, r"-{2,}", "-")
    cleaned = F.regexp_replace(cleaned, r"\s*([.\-])\s*", "$1")
    return let(F.lower(cleaned), lambda lowered: _read_id(raw, lowered))


def _read_id(raw: Column, lowered: Column) -> Column:
    shape = r"^gr([a-z0-9]+)[.\-\s]?([^\n]*)$"
    read_number = F.regexp_extract(lowered, shape, 1)
    slug = F.regexp_replace(F.regexp_extract(lowered, shape, 2), r"[^a-z0-9\-]", "")
    parts = F.struct(
        read_number.alias("read"),
        F.regexp_replace(
            F.translate(read_number, K.DIGIT_LOOKALIKES, K.DIGIT_MEANINGS), "[^0-9]", ""
        ).alias("number"),
        F.regexp_replace(F.regexp_replace(slug, r"-{2,}", "-"), r"^-+|-+$", "").alias("slug"),
    )
    return let(parts, lambda p: _id_outcome(raw, lowered, p["read"], p["number"], p["slug"]))


def _id_outcome(raw: Column, lowered: Column, read_number: Column, number: Column, slug: Column) -> Column:
    candidate = F.when(
        has_text(raw) & (number != "") & (slug != ""), F.concat(F.lit("gr"), number, F.lit("."), slug)
    )
    # An id without a prefix has an empty number on both sides.
    digits_changed = number != read_number
    notes = F.array_compact(F.array(
        F.when(digits_changed,
               F.concat(F.lit("segment numerique '"), read_number, F.lit("' -> '"), number, F.lit("'"))),
        F.when(candidate.isNotNull() & (lowered != candidate),
               F.concat(F.lit("nettoyage separateurs: '"), raw, F.lit("' -> '"), candidate, F.lit("'"))),
    ))
    return F.struct(
        candidate.alias("normalized"),
        candidate.isNotNull().alias("valid"),
        notes.alias("corrections"),
        F.when(candidate.isNull(), 0.0).when(digits_changed, 0.75).otherwise(1.0).alias("confidence"),
    )


def validation_errors(raw_id: Column, norm_id: Column, raw_date: Column, norm_date: Column) -> Column:
    """Messages for one imported row; an empty array means the row is valid."""

    def quoted(message: str, value: Column) -> Column:
        before, after = message.split("{}")
        return F.concat(F.lit(before), value, F.lit(after))

    return F.array_compact(F.array(
        F.when(non_empty(raw_id).isNull(), K.ERROR_ID_MISSING)
        .when(norm_id.isNull(), quoted(K.ERROR_ID_FORMAT, raw_id)),
        F.when(non_empty(raw_date).isNull(), K.ERROR_DATE_MISSING)
        .when(norm_date.isNull(), quoted(K.ERROR_DATE_FORMAT, raw_date)),
    ))
