"""Money text and discounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import ColumnLike, number, text


def truncated(amount: ColumnLike) -> Column:
    """Whole part of an amount text."""
    return number(amount).try_cast("bigint")


def has_no_discount(percent: ColumnLike) -> Column:
    col = text(percent)
    return col.isNull() | col.isin("0%", "N/A")


def percent_value(percent: ColumnLike) -> Column:
    return number(F.translate(text(percent), "%", ""))


def discounted(amount: ColumnLike, percent: ColumnLike) -> Column:
    """Amount after a percentage text, applied once and truncated."""
    price = number(amount)
    reduced = price * (F.lit(1) - percent_value(percent) / F.lit(100))
    return F.when(has_no_discount(percent), price).otherwise(reduced).try_cast("bigint")


def discounted_or_zero(amount: ColumnLike, percent: ColumnLike) -> Column:
    """Discounted amount, zero when no discount applies; a missing percentage counts as zero."""
    rate = F.coalesce(percent_value(percent), F.lit(0.0))
    return F.when(rate == 0, F.lit(0.0)).otherwise(number(amount) * (F.lit(1) - rate / F.lit(100)))


def discount_class(percent: ColumnLike) -> Column:
    col = text(percent)
    none = col.isNull() | col.isin(*fixed.NO_DISCOUNT_TEXTS)
    return F.when(none, F.lit("Sin Descuento")).otherwise(F.lit("Con Descuento"))


def plain_discount(percent: ColumnLike) -> Column:
    """Discount text with every 'none' spelling turned into '0'."""
    col = text(percent)
    none = col.isNull() | col.isin("0%", "N/A", "Sin Descuento")
    return F.when(none, F.lit("0")).otherwise(col)


def discount_flag(percent: ColumnLike) -> Column:
    return F.when(percent_value(percent) == 0, F.lit("No Aplica")).otherwise(F.lit("Aplica"))


def counted_flag(count: ColumnLike) -> Column:
    return F.when(number(count) >= 1, F.lit("Aplica")).otherwise(F.lit(""))


def money_text(amount: ColumnLike, separator: str = ".") -> Column:
    """'$ 1.234.567'; the e-mail job keeps ',' as separator."""
    grouped = F.format_number(truncated(amount), 0)
    return F.concat(F.lit("$ "), grouped if separator == "," else F.replace(grouped, F.lit(","), F.lit(separator)))


def decimal_comma(amount: ColumnLike) -> Column:
    return F.translate(text(amount), ".", ",")


def parsed_amount(amount: ColumnLike) -> Column:
    """Number of a text whose decimal mark is '.' or ','."""
    return number(F.translate(text(amount), ",", "."))


def usable_amount(amount: ColumnLike) -> Column:
    return F.coalesce(parsed_amount(amount), F.lit(0.0)) >= fixed.SMALLEST_PAYMENT


def without_thousands(amount: ColumnLike) -> Column:
    """Whole number of a text whose '.' separates thousands."""
    return F.translate(text(amount), ".", "").try_cast("bigint")
