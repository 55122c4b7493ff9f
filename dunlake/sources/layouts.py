"""Recognising and harmonising file layouts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import text
from dunlake.operators.projection import conform, normalise_headers, quoted
from dunlake.operators.unions import union_all


def classify_layout(columns: Iterable[str], layouts: Sequence[tuple[str, Sequence[str]]] = fixed.VENDOR_LAYOUTS) -> str:
    """Name of the first layout whose header set is contained in the columns."""
    present = {c.strip().lower() for c in columns}
    for name, required in layouts:
        if present.issuperset(required):
            return name
    return fixed.UNKNOWN_LAYOUT


def harmonise(
    tables: Sequence[DataFrame],
    layouts: Sequence[Sequence[str]] = fixed.BOT_REPORT_LAYOUTS,
    target: Sequence[str] = fixed.BOT_REPORT_COLUMNS,
) -> DataFrame | None:
    """Tables of a known layout in one target layout; others are left out.

    Only the call date is renamed. Name, surname and benefit answer are carried
    by tables that already have the target layout, and are null otherwise.
    """
    parts = []
    for table in map(normalise_headers, tables):
        columns = tuple(table.columns)
        if columns == tuple(target):
            parts.append(conform(table, target))
        elif columns in {tuple(layout) for layout in layouts}:
            renamed = table.withColumnsRenamed({"fecha_estado_final": "fecha_llamada"})
            parts.append(conform(renamed.drop("nombre", "apellido", "desea_beneficios"), target))
    return union_all(parts) if parts else None


def find_column(df: DataFrame, pattern: str = fixed.GROUPING_WORDS, skip: Sequence[str] = ("nombre_campana",)) -> str | None:
    """First column with any value matching a pattern: one aggregate, one row to the driver."""
    names = [c for c in df.columns if c not in set(skip)]
    checks = [
        F.coalesce(F.bool_or(F.lower(text(quoted(c))).rlike(pattern)), F.lit(False)).alias(f"c{i}")
        for i, c in enumerate(names)
    ]
    found = df.agg(*checks).first()
    return next((name for i, name in enumerate(names) if found[f"c{i}"]), None)
