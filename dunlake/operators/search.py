"""Substring search over all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions.base import text
from dunlake.session import small_table


def search(df: DataFrame, terms: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per row and term found in any column, with the term in ``Dato_Buscado``.

    The terms are a literal array filtered inside each row, so only hits are
    generated and nothing is joined.
    """
    cells = [F.coalesce(text(F.col(f"`{c}`")), F.lit("")) for c in (columns or df.columns)]
    hits = F.filter(
        F.array(*[F.lit(term) for term in terms]),
        lambda term: F.exists(F.array(*cells), lambda cell: F.contains(cell, term)),
    )
    return df.withColumn("Dato_Buscado", F.explode(hits))


def search_summary(hits: DataFrame, terms: Sequence[str], file: str | None = None) -> DataFrame:
    """Hits per term, also for terms without any."""
    counts = [F.count("*").alias("_hits")]
    if file is not None:
        counts.append(F.count_distinct(F.col(file)).alias("_files"))
    grouped = hits.groupBy("Dato_Buscado").agg(*counts)
    wanted = small_table(hits.sparkSession, {"Dato_Buscado": list(terms)})
    total = F.coalesce("_hits", F.lit(0))
    result = [
        "Dato_Buscado",
        F.when(total > 0, F.lit("SI")).otherwise(F.lit("NO")).alias("Encontrado"),
        total.alias("Total_Coincidencias"),
        F.when(total > 0, F.lit("ENCONTRADO")).otherwise(F.lit("NO_ENCONTRADO")).alias("Estado"),
    ]
    if file is not None:
        result.append(F.coalesce("_files", F.lit(0)).alias("Archivos_Con_Coincidencias"))
    return wanted.join(grouped, "Dato_Buscado", "left").select(*result)
