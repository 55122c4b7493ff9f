"""Projections, renames and predicates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.amounts import discount_class
from dunlake.functions.base import ColumnLike, as_column, number, text
from dunlake.functions.dates import from_month_of


def quoted(name: str) -> Column:
    """Column by its exact name, also with spaces and dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def rename(df: DataFrame, names: Mapping[str, str], only_mapped: bool = False) -> DataFrame:
    """Rename by map; ``only_mapped`` also fixes the column order to the map's."""
    if only_mapped:
        return df.select(*[quoted(old).alias(new) for old, new in names.items()])
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def conform(df: DataFrame, columns: Mapping[str, str] | Sequence[str], blank: str | None = None) -> DataFrame:
    """Fixed columns in fixed order; missing ones become null, or ``blank``."""
    types = columns if isinstance(columns, Mapping) else dict.fromkeys(columns, "string")
    return df.select(
        *[
            (quoted(name).cast(kind) if name in df.columns else F.lit(blank).cast(kind)).alias(name)
            for name, kind in types.items()
        ]
    )


def pick(df: DataFrame, candidates: Sequence[str], required: bool = True) -> Column:
    """First present column of several candidates, chosen when the plan is built."""
    for name in candidates:
        if name in df.columns:
            return quoted(name)
    if required:
        raise ValueError(f"none of the columns {list(candidates)} is present")
    return F.lit(None).cast("string")


def resolve_aliases(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], optional: Iterable[str] = ()
) -> DataFrame:
    """Project to the canonical names of an alias table."""
    optional = set(optional)
    return df.select(
        *[pick(df, names, required=target not in optional).alias(target) for target, names in aliases.items()]
    )


def normalised_name(name: str, mode: str) -> str:
    """Header in one of the modes ``lower``, ``word`` or ``ascii``."""
    if mode == "lower":
        return name.strip().lower()
    if mode == "word":
        return re.sub(r"[^\w]", "", name.strip().lower().replace(" ", ""))
    if mode == "ascii":
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        return re.sub(r"[{}.,]", "", plain).strip()
    raise ValueError(f"unknown header mode {mode!r}")


def normalise_headers(df: DataFrame, mode: str = "lower") -> DataFrame:
    return df.toDF(*unique_names([normalised_name(name, mode) for name in df.columns]))


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get a ``_n`` suffix counted from the second occurrence."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        result.append(name if seen[name] == 1 else f"{name}_{seen[name] - 1}")
    return result


def prefix_groups(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keep the known columns that exist, prefixed by their group, lower case, '_' for ' '."""
    return df.select(
        *[
            quoted(name).alias(prefix + name.lower().replace(" ", "_"))
            for prefix, names in groups.items()
            for name in names
            if name in df.columns
        ]
    )


def map_schema(
    df: DataFrame,
    target: Sequence[str],
    mapping: Mapping[str, str],
    literals: Mapping[str, str] | None = None,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Target columns from derived expressions, literals, mapped sources, or null."""
    literals, derived = literals or {}, derived or {}

    def value(name: str) -> Column:
        if name in derived:
            return derived[name]
        if name in literals:
            return F.lit(literals[name])
        source = mapping.get(name)
        return quoted(source).cast("string") if source in df.columns else F.lit(None).cast("string")

    return df.select(*[value(name).alias(name) for name in target])


def with_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def filter_members(df: DataFrame, members: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keep rows whose columns are all in their lists; null is in no list."""
    for name, values in members.items():
        df = df.filter(quoted(name).isin(*values))
    return df


def is_open_payment(payment: ColumnLike, allow_partial: bool = True) -> Column:
    col = text(payment)
    kinds = [kind for kind in fixed.OPEN_PAYMENT_TYPES if allow_partial or kind != "Pago Parcial"]
    return col.isNull() | col.isin(*kinds)


def is_due_on(due: ColumnLike, day: str | None) -> Column:
    """Due-date equality, or everything when no day is given."""
    return F.lit(True) if day is None else text(due) == day


def amount_between(amount: ColumnLike, low: float, high: float) -> Column:
    return number(amount).between(low, high)


def has_benefit(percent: ColumnLike, wanted: str | None) -> Column:
    """Filter on the discount class, or everything when none is wanted."""
    return F.lit(True) if wanted is None else discount_class(percent) == wanted


def not_contacted_on(contact_day: ColumnLike, day: date) -> Column:
    """Rows without contact on a day; a missing contact day counts as never."""
    col = text(contact_day)
    known = F.when(col.isNull() | (col == ""), F.lit(fixed.NEVER_CONTACTED)).otherwise(col)
    return known != F.lit(day.isoformat())


def exclude_profiles(df: DataFrame, columns: Sequence[str], bad: Sequence[str] = fixed.BAD_PROFILES) -> DataFrame:
    """Drop rows with a bad or missing profile in any of the columns."""
    for name in columns:
        df = df.filter(~quoted(name).isin(*bad))
    return df


def all_profiles_equal(df: DataFrame, account: str, columns: Sequence[str], value: str, as_of: date) -> DataFrame:
    """Distinct accounts whose profiles all equal a value, stamped with a date.

    The filter runs before the distinct, so only the kept accounts are shuffled.
    """
    for name in columns:
        df = df.filter(quoted(name) == value)
    return (
        df.select(F.translate(text(quoted(account)), "-", "").alias("CUENTA"), *[quoted(c) for c in columns])
        .distinct()
        .select("CUENTA", F.lit(as_of.isoformat()).alias("FECHA"))
    )


def without_text(df: DataFrame, name: str, part: str) -> DataFrame:
    """Drop rows whose column holds a text; null drops as well."""
    return df.filter(~quoted(name).contains(part))


def validity(customer_type: ColumnLike, *required: ColumnLike) -> Column:
    """True for a whole customer type in 80-89 with every required field present; never null."""
    valid = F.coalesce(text(customer_type).try_cast("int").between(80, 89), F.lit(False))
    for field in required:
        valid = valid & as_column(field).isNotNull()
    return valid


def split_valid(df: DataFrame, customer_type: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    good = validity(quoted(customer_type), *[quoted(name) for name in required])
    return df.filter(good), df.filter(~good)


def from_month(df: DataFrame, name: str, as_of: date) -> DataFrame:
    return df.filter(from_month_of(quoted(name), as_of))


def drop_header_rows(df: DataFrame, name: str, title: str) -> DataFrame:
    """Drop header lines that arrived as data after a union."""
    return df.filter(quoted(name) != title)


def routed(df: DataFrame, routes: Mapping[str, Column], column: str = "ruta") -> DataFrame:
    """One copy of a row per route whose predicate holds, labelled with the route.

    One pass over the input serves all outputs: write it partitioned by the label.
    """
    labels = F.filter(
        F.array(*[F.when(predicate, F.lit(name)) for name, predicate in routes.items()]),
        lambda label: label.isNotNull(),
    )
    return df.withColumn(column, F.explode(labels))
