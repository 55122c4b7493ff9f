"""Vendor reports from files to facts (B25): layouts recognised, summed by hour, joined to one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlake.functions import classes
from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import text
from dunlake.operators import aggregates as a
from dunlake.operators.projection import normalise_headers, quoted
from dunlake.session import store
from dunlake.sources.folders import read_text_files
from dunlake.sources.layouts import classify_layout, find_column


def vendor_spec(kind: str, df: DataFrame) -> a.VolumeSpec | None:
    """How a recognised report with normalised headers is summed; null for an unknown layout.

    Voice reports of the first vendor are also split by the column that tells standard from personalised campaigns,
    which has no fixed name. Bot reports count answers of persons, unless they are split by brand.
    """
    if kind in fixed.VENDOR_COLUMNS:
        time, group, value, cost = fixed.VENDOR_COLUMNS[kind]
        keywords = fixed.VENDOR_KEYWORDS.get(kind)
        grouped = quoted(group) if keywords is None else classes.keyword_group(quoted(group), keywords)
        split = find_column(df) if kind == "ivr_1" else None
        return a.VolumeSpec(
            kind, quoted(time), grouped, quoted(value), extra_group=quoted(split) if split else None, cost=quoted(cost) if cost else None
        )
    if not kind.startswith("bot_"):
        return None
    time = next(c for c in ("fecha_estado_final", "fecha_llamada") if c in df.columns)
    by_brand = "marca" in df.columns
    person = None if by_brand else F.lower(F.coalesce(text("estado_llamada"), F.lit("nan"))) != fixed.MACHINE_ANSWER
    return a.VolumeSpec(kind, time, "marca" if by_brand else quoted("campaña"), "tiempo_llamada", keep=person)


def hourly_volumes(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame | None:
    """Exact hourly sums of all recognised reports below a folder, each layout read once; null when there is none."""

    def summed(table: DataFrame) -> DataFrame:
        headed = normalise_headers(table)
        spec = vendor_spec(classify_layout(headed.columns), headed)
        return table.sparkSession.createDataFrame([], "fuente string") if spec is None else a.volume_sums(headed, spec, "HOUR")

    parts = read_text_files(spark, folder, pattern, recursive=True, each=summed)
    return None if parts is None else parts.filter(F.col("fuente").isNotNull())


def vendor_folder_facts(
    spark: SparkSession, folder: str, own: Sequence[str | None] = (None, None, None), pattern: str = "*.csv"
) -> tuple[DataFrame, DataFrame]:
    """Daily invoicing fact and hourly campaign fact of a folder of reports.

    The hourly sums are stored once; the daily ones are added up from them, so no report is read twice.
    """
    hours = hourly_volumes(spark, folder, pattern)
    if hours is None:
        raise FileNotFoundError(f"no report {pattern} below {folder}")
    for name, kind in (("tipo", "string"), ("costo", a.SUM_TYPE)):
        if name not in hours.columns:
            hours = hours.withColumn(name, F.lit(None).cast(kind))
    hours = store(hours, "vendor-hours")
    keys = ["agrupador", "tipo", "fuente"]
    daily = hours.groupBy(F.date_trunc("DAY", "fecha_movimiento").alias("fecha_movimiento"), *keys).agg(
        *[F.sum(c).cast(a.SUM_TYPE).alias(c) for c in ("valor_movimiento", "costo")]
    )
    plain = [a.as_double(table) for table in (daily, hours)]
    return a.volume_fact(plain[:1], *own), a.volume_fact([plain[1].withColumn("registros", F.col("valor_movimiento"))], *own)
