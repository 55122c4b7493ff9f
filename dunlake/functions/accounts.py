"""Account and identifier text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlake.functions.base import ColumnLike, is_blank, text


def without_dashes(account: ColumnLike) -> Column:
    return F.translate(text(account), "-", "")


def without_points(account: ColumnLike) -> Column:
    """Account without '.' and '-'."""
    return F.translate(text(account), ".-", "")


def without_zero_decimal(account: ColumnLike) -> Column:
    """Drop a trailing '.0' left by a numeric cell."""
    return F.regexp_replace(text(account), r"\.0$", "")


def guarded(account: ColumnLike) -> Column:
    """Append '-' so that spreadsheets keep the account as text."""
    return F.concat(text(account), F.lit("-"))


def last_nine(account: ColumnLike) -> Column:
    return F.right(F.translate(text(account), ".", ""), F.lit(9))


def before_comma(account: ColumnLike) -> Column:
    return F.split_part(F.translate(text(account), ".", ""), F.lit(","), F.lit(1))


def composite_key(*parts: ColumnLike, separator: str = "-") -> Column:
    """Joined key; null when any part is null."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(separator), text(part)] if pieces and separator else [text(part)]
    return F.concat(*pieces)


def digits_only(value: ColumnLike) -> Column:
    return F.regexp_replace(text(value), "[^0-9]", "")


def letters_only(value: ColumnLike) -> Column:
    return F.regexp_replace(text(value), "[^a-zA-Z]", "")


def joined_lines(*columns: ColumnLike) -> Column:
    """Comma list of line columns, with runs of commas collapsed to one."""
    joined = F.concat_ws(",", *[F.coalesce(text(c), F.lit("")) for c in columns])
    return F.regexp_replace(joined, ",{2,}", ",")


def reference_number(origin: ColumnLike, account: ColumnLike, reference: ColumnLike) -> Column:
    """Payment reference: the account for RR, and a fixed text when there is none."""
    chosen = F.when(text(origin) == "RR", text(account)).otherwise(text(reference))
    plain = without_dashes(chosen)
    return F.when(plain != "", plain).otherwise(F.lit("SIN REFERENCIA"))


def reference_flag(reference: ColumnLike) -> Column:
    return F.when(text(reference) != "", F.lit("Con referencia")).otherwise(F.lit("SIN REFERENCIA"))


def reference_flag_by_length(reference: ColumnLike) -> Column:
    return F.when(F.length(text(reference)) > 3, F.lit("Con referencia")).otherwise(F.lit("Sin Referencia"))


def default_reference(reference: ColumnLike, origin: ColumnLike) -> Column:
    """Missing reference: the origin for RR, else '0'."""
    col = text(reference)
    return F.when(col.isNotNull(), col).when(text(origin) == "RR", text(origin)).otherwise(F.lit("0"))


def client_number(document: ColumnLike, account: ColumnLike) -> Column:
    """Document digits as a plain number, or the account when shorter than two digits."""
    plain = F.coalesce(digits_only(document).try_cast("bigint"), F.lit(0)).cast("string")
    return F.when(F.length(plain) < 2, without_points(account)).otherwise(plain)


def without_pipes(df: DataFrame) -> DataFrame:
    """Remove '|' from every text column."""
    return df.select(
        *[
            F.translate(F.col(f"`{field.name}`"), "|", "").alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else F.col(f"`{field.name}`")
            for field in df.schema.fields
        ]
    )


def blank_as(value: ColumnLike, replacement: str) -> Column:
    return F.when(is_blank(value), F.lit(replacement)).otherwise(text(value))
