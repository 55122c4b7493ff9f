"""Banding of amounts and day counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import ColumnLike, first_match, number


def upper_bound_band(value: ColumnLike, edges: Sequence[float], labels: Sequence[str], above: str) -> Column:
    """Label of the first edge not below the value; null and text fall in ``above``."""
    amount = number(value)
    rules = [(amount <= F.lit(edge), F.lit(label)) for edge, label in zip(edges, labels, strict=True)]
    return first_match(rules, F.lit(above))


def debt_band(value: ColumnLike) -> Column:
    return upper_bound_band(value, fixed.DEBT_EDGES, fixed.DEBT_LABELS, fixed.DEBT_ABOVE)


def discount_band(value: ColumnLike) -> Column:
    """Debt band of a discounted amount, where zero means no discount applies."""
    return F.when(number(value) == 0, F.lit(fixed.NO_DISCOUNT_BAND)).otherwise(debt_band(value))


def range_band(days: ColumnLike, bands: Sequence[tuple[int, int, str]], default: Column) -> Column:
    count = number(days)
    return first_match([(count.between(low, high), F.lit(label)) for low, high, label in bands], default)


def day_band(days: ColumnLike) -> Column:
    return range_band(days, fixed.DAY_BANDS, F.lit(fixed.OUT_OF_RANGE))


def overdue_band(days: ColumnLike) -> Column:
    bands = (fixed.NOT_YET_DUE_BAND, *fixed.DAY_BANDS, fixed.LONG_OVERDUE_BAND)
    outside = F.when(number(days).isNull(), F.lit(fixed.NULL_BAND)).otherwise(F.lit(fixed.OUT_OF_RANGE))
    return range_band(days, bands, outside)
