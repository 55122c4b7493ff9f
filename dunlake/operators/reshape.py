"""Unpivot, pivot and list cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlake.functions.base import ColumnLike, as_column, text
from dunlake.functions.contacts import trimmed_list_cell
from dunlake.operators.dedup import ranked, top_rows


def unpivot_slots(
    df: DataFrame, columns: Sequence[str], value: str, keep_nulls: bool = True, distinct: bool = False
) -> DataFrame:
    """One row per slot column; every other column is kept.

    ``distinct`` drops values repeated in a row before they are multiplied.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in set(columns)]
    slots = F.array(*[text(F.col(f"`{c}`")) for c in columns])
    if not keep_nulls:
        slots = F.filter(slots, lambda item: item.isNotNull())
    if distinct:
        slots = F.array_distinct(slots)
    return df.select(*others, F.explode(slots).alias(value))


def slot_names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(1, n + 1)]


def pivot_slots(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[ColumnLike],
    value: str,
    n: int,
    prefix: str,
    kept: Sequence[str] = (),
) -> DataFrame:
    """First ``n`` values of a key as ``prefix1..n``, '' where there is none.

    ``kept`` columns come from the first row of the key. The ranking and the
    aggregate share one shuffle and one sort, and no list is collected.
    """
    ranked_rows = top_rows(df, keys, order, n, "_rank")
    firsts = [F.max(F.when(F.col("_rank") == 1, F.col(f"`{c}`"))).alias(c) for c in kept]
    slots = [
        F.coalesce(F.max(F.when(F.col("_rank") == i, F.col(f"`{value}`"))), F.lit("")).alias(name)
        for i, name in enumerate(slot_names(prefix, n), 1)
    ]
    return ranked_rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*firsts, *slots)


def explode_list(df: DataFrame, cell: str, value: str, separator: str = r"\|", drop_blank: bool = False) -> DataFrame:
    """One row per item of a delimited list cell; a null cell gives no row."""
    rows = df.withColumn(value, F.explode(F.split(trimmed_list_cell(F.col(f"`{cell}`")), separator)))
    return rows.filter(F.col(value) != "") if drop_blank else rows


def items_per_key(
    df: DataFrame, key: str, item: ColumnLike, name: str, separator: str = ";", limit: int = 100_000
) -> DataFrame:
    """Distinct items of a key as texts of up to ``limit`` items, in order: (key, parte, items), parts from 0.

    An item's part follows from its rank in the key, so every key has the same form, whatever its size; nothing is
    dropped and no list outgrows a task.
    """
    pairs = df.select(key, text(as_column(item)).alias("_item")).filter(F.col("_item").isNotNull()).distinct()
    part = F.floor((F.col("_rank") - 1) / F.lit(limit)).cast("bigint")
    return (
        ranked(pairs, [key], ["_item"], "_rank")
        .select(key, "_item", part.alias("parte"))
        .groupBy(key, "parte")
        .agg(F.concat_ws(separator, F.sort_array(F.collect_list("_item"))).alias(name))
    )


def chunk_slots(df: DataFrame, columns: Sequence[str], size: int, prefix: str, chunk: str = "bloque") -> DataFrame:
    """Stack slot columns into rows of ``size`` slots each."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in set(columns)]
    groups = [columns[i : i + size] for i in range(0, len(columns), size)]
    rows = F.array(*[F.array(*[text(F.col(f"`{c}`")) for c in group]) for group in groups])
    stacked = df.select(*others, F.posexplode(rows).alias("_at", "_group"))
    return stacked.select(
        *others,
        (F.col("_at") + 1).alias(chunk),
        *[F.get("_group", F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(size)],
    )


def filled_slots(columns: Sequence[str], condition) -> Column:
    """Number of slot columns for which ``condition(column)`` holds."""
    return F.size(F.filter(F.array(*[F.col(f"`{name}`") for name in columns]), condition))
