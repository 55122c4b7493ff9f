"""Place to department by ordered town rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import is_blank, text

def map_region(
    df: DataFrame,
    place: str,
    rules: DataFrame,
    departments: Sequence[str] | None = fixed.DEPARTMENTS,
    name: str = "DEPARTAMENTO",
) -> DataFrame:
    """Department of the first rule (by ``prioridad``) whose town is part of the place.

    ``rules`` has prioridad, pueblo and departamento. Each distinct place gives its
    parts of the lengths that towns have, which are joined with the towns: the work
    follows the length of the places, not the number of rules.
    """
    town = F.upper(F.split_part(F.when(is_blank(place), F.lit(fixed.EMPTY_PLACE)).otherwise(text(place)), F.lit("/"), F.lit(1)))
    usable = rules if departments is None else rules.filter(F.col("departamento").isin(*departments))
    lengths = usable.agg(F.array_sort(F.collect_set(F.length("pueblo")))).scalar()
    rows = df.withColumn("_town", town)
    places = rows.select("_town").distinct()
    parts = places.select("_town", F.explode(lengths).alias("_length")).filter(F.col("_length") <= F.length("_town"))
    starts = F.sequence(F.lit(1), F.length("_town") - F.col("_length") + 1)
    parts = parts.select("_town", "_length", F.explode(starts).alias("_start")).select(
        "_town", F.col("_town").substr(F.col("_start"), F.col("_length")).alias("_part")
    ).distinct()
    found = parts.join(usable.select("prioridad", "pueblo", "departamento"), F.col("_part") == F.col("pueblo")).groupBy("_town").agg(
        F.min_by("departamento", F.struct("prioridad", "pueblo", "departamento")).alias("_found")
    )
    own_name = F.when(F.col("_town").isin(*departments), F.col("_town")) if departments else F.lit(None)
    mapped = places.join(found, "_town", "left").select(
        "_town",
        F.when(F.col("_town") == fixed.EMPTY_PLACE, F.lit(fixed.EMPTY_PLACE))
        .otherwise(F.coalesce("_found", own_name, F.lit(fixed.UNKNOWN_DEPARTMENT)))
        .alias(name),
    )
    return rows.join(mapped, "_town", "left").drop("_town")
