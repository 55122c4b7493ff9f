"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    """Column by name, or the given column."""
    return F.col(value) if isinstance(value, str) else value


def text(value: ColumnLike) -> Column:
    return as_column(value).cast("string")


def number(value: ColumnLike) -> Column:
    """Double, null when the text is not a number."""
    return text(value).try_cast("double")


def whole(value: ColumnLike) -> Column:
    """Whole number of a number text of up to 38 digits, its fraction cut off; null when the text is no such number.

    The pattern keeps bad texts away from the cast, where each would cost an exception.
    """
    col = text(value)
    is_number = col.rlike(r"^\s*[+-]?[0-9]{1,38}(\.[0-9]*)?\s*$")
    return F.when(is_number, F.split_part(col, F.lit("."), F.lit(1)).cast("decimal(38,0)"))


def is_blank(value: ColumnLike) -> Column:
    col = text(value)
    return col.isNull() | (F.trim(col) == "")


def first_match(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """CASE over ordered (condition, result) pairs."""
    (head, result), *tail = rules
    chain = F.when(head, result)
    for condition, value in tail:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small constant map; null when the key is unknown or null."""
    literals = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*literals), key)


def apply_each(col: Column, items, step) -> Column:
    """Apply ``step(col, item)`` for each item in order."""
    return reduce(step, items, col)


def drop_text(col: Column, part: str) -> Column:
    """Remove a literal piece of text."""
    return F.replace(col, F.lit(part), F.lit(""))


def contains_any(col: Column, parts: Sequence[str]) -> Column:
    """True when the text holds one of the literal parts."""
    pattern = "|".join(r"\Q" + part + r"\E" for part in parts)
    return col.rlike(pattern)
