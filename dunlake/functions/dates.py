"""Dates kept as text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import ColumnLike, as_column, text


def _date_in(day: Column, fmt: str) -> Column:
    parsed = F.try_to_date(day, fmt)
    if fmt.endswith("yyyy") or not fmt.endswith("yy"):
        return parsed
    # two-digit years from 69 on belong to the last century
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def parsed_date(value: ColumnLike, formats=fixed.PAYMENT_DATE_FORMATS) -> Column:
    """Date of a text in the first format that fits; null when none does."""
    day = F.split_part(F.split_part(text(value), F.lit(" "), F.lit(1)), F.lit(":"), F.lit(1))
    return F.coalesce(*[_date_in(day, fmt) for fmt in formats])


def iso_date(value: ColumnLike) -> Column:
    """yyyy-MM-dd text; a value in no known format is kept as it is."""
    return F.coalesce(parsed_date(value).cast("string"), text(value))


def slash_date(value: ColumnLike) -> Column:
    """Date of a d/M/yyyy text with or without leading zeros."""
    return F.try_to_date(F.trim(text(value)), "d/M/yyyy")


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Days from one d/M/yyyy text to another; null when either is missing."""
    return F.datediff(slash_date(later), slash_date(earlier))


def days_past_due(due: ColumnLike, as_of: date) -> Column:
    return F.datediff(F.lit(as_of), as_column(due))


def plain_timestamp(value: ColumnLike, suffix: str = ".000-05:00") -> Column:
    """Timestamp text with a blank for 'T' and without the zone suffix."""
    return F.replace(F.translate(text(value), "T", " "), F.lit(suffix), F.lit(""))


def day_part(value: ColumnLike) -> Column:
    return F.split_part(text(value), F.lit(" "), F.lit(1))


def hour_part(value: ColumnLike) -> Column:
    """First two characters of a time text."""
    return F.substring(text(value), 1, 2)


def first_item(value: ColumnLike) -> Column:
    return F.split_part(text(value), F.lit(","), F.lit(1))


def last_item(value: ColumnLike) -> Column:
    return F.split_part(text(value), F.lit(","), F.lit(-1))


def floor_to(value: ColumnLike, unit: str) -> Column:
    """Timestamp text or value floored to DAY or HOUR; null when it is no timestamp."""
    return F.date_trunc(unit, as_column(value).try_cast("timestamp"))


def from_month_of(value: ColumnLike, as_of: date) -> Column:
    """True for dates in the month of ``as_of`` or later."""
    return as_column(value) >= F.lit(as_of.replace(day=1))


def _name_piece(file_name: ColumnLike, position: int) -> Column:
    stem = F.regexp_replace(text(file_name), r"\.[^.]*$", "")
    parts = F.split(F.split_part(stem, F.lit(" "), F.lit(1)), "_")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(position)))


def file_name_date(file_name: ColumnLike) -> Column:
    """Date of a name like ``base_01022024_0930.csv``; null when malformed."""
    piece = _name_piece(file_name, -2)
    return F.when(F.length(piece) == 8, F.try_to_date(piece, "ddMMyyyy"))


def file_name_time(file_name: ColumnLike) -> Column:
    """HH:mm of such a name; null when malformed."""
    piece = _name_piece(file_name, -1)
    valid = piece.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$")
    return F.when(valid, F.concat_ws(":", F.substring(piece, 1, 2), F.substring(piece, 3, 2)))
