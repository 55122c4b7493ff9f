"""Aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import ColumnLike, as_column, number
from dunlake.functions.classes import bucket_label, mix_label, profile_group, unified_group
from dunlake.functions.dates import floor_to
from dunlake.operators.dedup import dedup, join_null_safe


#: A key with at least this share of the rows, as one in so many, is hot. There are at most as many hot keys.
HOT_SHARE = 1000


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Aggregates of a key joined back to its rows; null is a key like any other.

    An aggregate combines on the map side and its result is small; an unordered window would bring all rows of a key
    into one task. So would the join back, for a key that holds much of the table. Hot keys are therefore at most
    ``HOT_SHARE`` rows by definition and are broadcast; their rows go to the join on the key with a salt of their own,
    which spreads them and meets nothing there. The salt is a hash of the row and its partition, so that a task that runs
    again deals its rows as before.
    """
    grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count("*").alias("_size"), F.struct(*[expr.alias(name) for name, expr in stats.items()]).alias("_stats")
    )
    total = grouped.agg(F.sum("_size")).scalar()
    hot = grouped.filter(F.col("_size") * HOT_SHARE >= total).select(*[F.col(f"`{k}`") for k in keys], F.col("_stats").alias("_hot"))
    rows = join_null_safe(df, F.broadcast(hot), keys, "left")
    hashed = [F.col(f"`{f.name}`") for f in df.schema if not _holds_map(f.dataType)]
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.xxhash64(*hashed, F.spark_partition_id()).bitwiseOR(F.lit(1).cast("bigint")))
    rows = rows.withColumn("_salt", salt)
    joined = join_null_safe(rows, grouped.drop("_size").withColumn("_salt", F.lit(0).cast("bigint")), [*keys, "_salt"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce("_hot", "_stats")[name].alias(name) for name in stats],
    )


def _holds_map(kind: T.DataType) -> bool:
    """Whether a type holds a map, or another type without a hash."""
    return any(word in kind.simpleString() for word in ("map<", "variant"))


def touch_count(df: DataFrame, account: ColumnLike, brand: ColumnLike, resource: str, drop_zero: bool = False) -> DataFrame:
    """Contacts per account of one channel, with its lowest brand as representative."""
    rows = df.select(as_column(account).alias("cuenta"), as_column(brand).alias("marca"))
    if drop_zero:
        rows = rows.filter(F.col("cuenta") != "0")
    return (
        rows.groupBy("cuenta")
        .agg(F.min("marca").alias("marca"), F.count("*").alias("cantidad"))
        .withColumn("recurso", F.lit(resource))
    )


def touch_matrix(channels: Mapping[str, DataFrame], brands: Sequence[str] = fixed.TOUCH_BRANDS) -> DataFrame:
    """Counts of several channels side by side, one row per plain account.

    Each input has cuenta_real, cuenta_sin_punto, marca and cantidad. A union with
    conditional sums replaces the chain of full outer joins: one shuffle in place
    of one per join. Of several (account, brand) rows the lowest pair survives.
    """
    stacked = None
    for name, table in channels.items():
        part = table.select("cuenta_real", "cuenta_sin_punto", "marca", "cantidad", F.lit(name).alias("canal"))
        stacked = part if stacked is None else stacked.unionByName(part)
    counted = stacked.groupBy("cuenta_sin_punto", "cuenta_real", "marca").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("canal") == name, F.col("cantidad"))), F.lit(0)).alias(f"toques_{name}")
            for name in channels
        ]
    )
    survivor = dedup(
        counted, ["cuenta_sin_punto"], [F.col("cuenta_real").asc_nulls_last(), F.col("marca").asc_nulls_last()]
    )
    return survivor.withColumn("marca", F.lower("marca")).filter(F.col("marca").isin(*brands))


def contact_mix(df: DataFrame, account: str, profile: ColumnLike) -> DataFrame:
    """Direct, indirect and missing contacts per account with the mix label."""
    group = profile_group(profile)
    counted = df.groupBy(account).agg(
        *[
            F.count_if(group == code).alias(name)
            for code, name in (("CDIR", "contacto_directo"), ("CIND", "contacto_indirecto"), ("NOC", "no_contacto"))
        ]
    )
    return counted.withColumn("mezcla", mix_label("contacto_directo", "contacto_indirecto", "no_contacto"))


def multi_flags(df: DataFrame, document: str, origin: str, brand: str) -> DataFrame:
    """Whether a document has several accounts, origins or brands.

    Distinct counts are reduced to two values, so the aggregate needs no expansion:
    a group has several values when its smallest differs from its largest.
    """

    def flag(condition: Column) -> Column:
        return F.when(condition, F.lit("Aplica")).otherwise(F.lit("No aplica"))

    stats = with_group_stats(
        df,
        [document],
        _rows=F.count(document),
        _origins=F.min(origin) != F.max(origin),
        _brands=F.min(brand) != F.max(brand),
    )
    return stats.withColumns(
        {
            "MULTICUENTA": flag(F.col("_rows") > 1),
            "MULTIPRODUCTO": flag(F.col("_origins")),
            "MULTIMORA": flag(F.col("_brands")),
        }
    ).drop("_rows", "_origins", "_brands")


def brand_retire_flag(
    df: DataFrame, brand: str, status: str, special: Sequence[str] = fixed.SPECIAL_RANKING_BRANDS
) -> DataFrame:
    """RETIRAR for unranked rows of a special brand in which any row is ranked.

    The flags are at most one row per name in ``special``, so they are broadcast;
    a shuffle by brand would gather a large brand in one task.
    """
    ranked_brands = (
        df.filter(F.col(brand).isin(*special) & (F.col(status) != fixed.NO_RANKING))
        .select(F.col(brand).alias("_brand"))
        .distinct()
        .withColumn("_ranked", F.lit(True))
    )
    joined = df.join(F.broadcast(ranked_brands), df[brand] == F.col("_brand"), "left")
    retired = F.col("_ranked").isNotNull() & (F.col(status) == fixed.NO_RANKING)
    return joined.withColumn(status, F.when(retired, F.lit(fixed.RETIRE)).otherwise(F.col(status))).drop(
        "_brand", "_ranked"
    )


def recount(df: DataFrame, account: str, file_day: str, order: Sequence[ColumnLike]) -> DataFrame:
    """One row per account and file day, with the number of days the account occurs."""
    return with_group_stats(dedup(df, [account, file_day], order), [account], RECUENTO=F.count(account))


def account_counts(df: DataFrame, account: str, file_day: str) -> DataFrame:
    """Accounts with their number of distinct file days, without going back to the rows."""
    return df.select(account, file_day).distinct().groupBy(account).agg(F.count("*").alias("RECUENTO"))


def bucket_counts(df: DataFrame, bucket: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per normalised bucket, optionally per file."""
    rows = df.filter(F.col(bucket).isNotNull()).withColumn("Mora", bucket_label(bucket))
    return rows.groupBy(*by, "Mora").agg(F.count("*").alias("Cantidad"))


def type_counts(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("cantidad"))


@dataclass(frozen=True)
class VolumeSpec:
    """How one vendor layout is summed: time, group and value columns."""

    source: str
    time: ColumnLike
    group: ColumnLike
    value: ColumnLike
    extra_group: ColumnLike | None = None
    cost: ColumnLike | None = None
    keep: Column | None = field(default=None, compare=False)


SUM_TYPE = "decimal(38,10)"


def volume_sums(df: DataFrame, spec: VolumeSpec, unit: str = "DAY") -> DataFrame:
    """Exact sums per day or hour and group, as decimals with ten places.

    An invalid number counts as zero, a row without a valid time is dropped. Small
    costs add up, and the order of the rows does not matter.
    """

    def amount(column: ColumnLike) -> Column:
        return F.coalesce(number(column).try_cast("decimal(28,10)"), F.lit(0))

    rows = df if spec.keep is None else df.filter(spec.keep)
    moment = floor_to(spec.time, unit).alias("fecha_movimiento")
    keys = [moment, as_column(spec.group).alias("agrupador")]
    if spec.extra_group is not None:
        keys.append(as_column(spec.extra_group).alias("tipo"))
    sums = [F.sum(amount(spec.value)).cast(SUM_TYPE).alias("valor_movimiento")]
    if spec.cost is not None:
        sums.append(F.sum(amount(spec.cost)).cast(SUM_TYPE).alias("costo"))
    return (
        rows.filter(floor_to(spec.time, unit).isNotNull())
        .groupBy(*keys)
        .agg(*sums)
        .withColumn("fuente", F.lit(spec.source))
    )


def as_double(sums: DataFrame) -> DataFrame:
    return sums.withColumns({c: F.col(c).cast("double") for c in ("valor_movimiento", "costo") if c in sums.columns})


def volume(df: DataFrame, spec: VolumeSpec, unit: str = "DAY") -> DataFrame:
    """Sums per day or hour and group; only the exact sum becomes a double."""
    return as_double(volume_sums(df, spec, unit))


def daily_volume(df: DataFrame, spec: VolumeSpec) -> DataFrame:
    return volume(df, spec, "DAY")


def hourly_volume(df: DataFrame, spec: VolumeSpec) -> DataFrame:
    """Hourly sums with a copy of the value as record counter."""
    return volume(df, spec, "HOUR").withColumn("registros", F.col("valor_movimiento"))


def volume_fact(
    parts: Sequence[DataFrame], own_name: str | None = None, own_source: str | None = None, own_group: str | None = None
) -> DataFrame:
    """All vendor aggregates in one table with unified group names."""
    fact = parts[0]
    for part in parts[1:]:
        fact = fact.unionByName(part, allowMissingColumns=True)
    group = unified_group(
        "agrupador", own_name=own_name, own_source=F.col("fuente") == F.lit(own_source or ""), own_group=own_group
    )
    return fact.withColumn("agrupador", group)


def agent_results(reports: Sequence[DataFrame]) -> DataFrame:
    """Agent results with harmonised productivity and effectiveness columns.

    The report kind follows from the header: agreements and payments are money
    collected, services are accounts.
    """
    kinds = (
        ("Acuerdos", "Productividad", "Recaudo"),
        ("Pagos", "Efectividad", "Recaudo"),
        ("Servicios Gestionados", "Productividad", "Cuentas"),
        ("Servicios Recuperados", "Efectividad", "Cuentas"),
    )
    wanted = ["Día", "Tipologia Grupo", "Agente", "Productividad", "Efectividad", "Tipologia"]
    result = None
    for report in reports:
        for name, target, kind in kinds:
            if name in report.columns:
                report = report.withColumnRenamed(name, target).withColumn("Tipologia", F.lit(kind))
        part = report.select(*[c for c in wanted if c in report.columns])
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result

