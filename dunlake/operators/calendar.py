"""Daily assignment calendar of a month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlake.functions.bands import day_band

LAST_DAY = 31


def _has_day(mask: Column, day: Column) -> Column:
    return F.getbit(mask, day) == 1


def calendar(df: DataFrame, key: str, day: str) -> DataFrame:
    """State of each day 1-31 per key.

    Between the first and the last assigned day a missing day is 'Sin reasignar';
    the day after the last one is 'Retirada' when the month's data reach it.
    The days of a key are one bit mask: a fixed-width buffer that is combined on
    the map side, however many rows a key has.
    """
    last_of_all = df.agg(F.max(day)).scalar()
    masks = df.groupBy(key).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(day).cast("int"))).alias("_mask"),
        F.min(day).alias("primer_dia"),
        F.max(day).alias("ultimo_dia"),
    ).withColumn("_limit", last_of_all)

    def state(d: Column) -> Column:
        return (
            F.when(_has_day(F.col("_mask"), d), F.lit("Asignada"))
            .when((d > F.col("primer_dia")) & (d < F.col("ultimo_dia")), F.lit("Sin reasignar"))
            .when((d == F.col("ultimo_dia") + 1) & (d <= F.col("_limit")), F.lit("Retirada"))
            .otherwise(F.lit(""))
        )

    days = F.transform(F.sequence(F.lit(1), F.lit(LAST_DAY)), state)
    return masks.withColumn("dias", days).drop("_mask", "_limit")


def calendar_summary(calendars: DataFrame, month: Column | str = "1/2024") -> DataFrame:
    """Counts, entry and exit dates, account state and span band of each calendar.

    ``month`` is the month and year text appended to the day numbers.
    """
    suffix = F.lit(month) if isinstance(month, str) else month

    def days_in(*states: str) -> Column:
        return F.size(F.filter("dias", lambda d: d.isin(*states)))

    assigned, missing = days_in("Asignada"), days_in("Retirada", "Sin reasignar")
    retired_at = F.array_position("dias", "Retirada")
    return (
        calendars.withColumn("dias_asignada", assigned)
        .withColumn("dias_retirada", missing)
        .withColumn("rango_de_dias", F.col("dias_asignada") + F.col("dias_retirada"))
        .withColumn("fecha_ingreso", F.concat_ws("/", F.col("primer_dia").cast("string"), suffix))
        .withColumn(
            "fecha_retiro",
            F.when(retired_at > 0, F.concat_ws("/", retired_at.cast("string"), suffix)).otherwise(F.lit("-")),
        )
        .withColumn("estado_cuenta", F.when(retired_at > 0, F.lit("Recuperada")).otherwise(F.lit("En gestion")))
        .withColumn("grupo_rango_de_dias", day_band("rango_de_dias"))
    )


def day_columns(calendars: DataFrame, prefix: str = "Dia_") -> DataFrame:
    """Slot columns of the calendar for the sink."""
    others = [c for c in calendars.columns if c != "dias"]
    return calendars.select(*others, *[F.get("dias", F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(LAST_DAY)])
