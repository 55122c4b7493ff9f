"""Payment and ranking jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlake.functions import accounts, amounts, classes, dates
from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import text
from dunlake.operators import projection as p
from dunlake.operators.aggregates import account_counts, with_group_stats
from dunlake.operators.dedup import dedup
from dunlake.operators.unions import union_all
from dunlake.sources.folders import read_text_files
from dunlake.sources.sinks import write_by_key


def cleaned_payments(df: DataFrame, origin: str = "archivo", operation: str = "tipo_operacion") -> DataFrame:
    """Obligation, date, decimal value and file of each usable payment; adjustments are dropped."""
    rows = df
    if operation in df.columns:
        rows = df.filter(~F.col(operation).eqNullSafe(fixed.ADJUSTMENT))
    return rows.filter(amounts.usable_amount("valor")).select(
        accounts.before_comma("obligacion").alias("obligacion"),
        dates.parsed_date("fecha").alias("fecha"),
        amounts.parsed_amount("valor").alias("valor_decimal"),
        F.col(origin).alias("origen"),
    )


def own_campaign(df: DataFrame) -> DataFrame:
    """Rows of our campaign where the layout names collection houses; other layouts hold only ours."""
    if fixed.HOUSE_COLUMN not in df.columns:
        return df
    return df.filter(F.col(fixed.CAMPAIGN_CODE_COLUMN) == fixed.OWN_CAMPAIGN_CODE)


def read_payments(spark: SparkSession, folder: str, separators: Mapping[str, Sequence[str]] = fixed.PAYMENT_SEPARATORS) -> DataFrame:
    """Payment files below a folder: obligacion, fecha, valor, tipo_operacion and the file in ``archivo``.

    ``separators`` gives each extension's separators; a layout's is the first of them that occurs in its header. Lines of a
    wrong number of fields are left out, layouts with collection houses limited to our campaign, and columns renamed.
    """

    def renamed(table: DataFrame) -> DataFrame:
        names = fixed.PAYMENT_ALIASES | {"tipo_operacion": ("tipo_operacion",), "archivo": ("archivo",)}
        return p.resolve_aliases(own_campaign(table), names, optional=("tipo_operacion",))

    common = {"recursive": True, "origin": "archivo", "each": renamed, "malformed": "DROPMALFORMED"}
    read = [
        read_text_files(spark, folder, f"*.{extension}", order=order, ignoreLeadingWhiteSpace=str(extension == "csv").lower(), **common)
        for extension, order in separators.items()
    ]
    parts = [part for part in read if part is not None]
    if not parts:
        raise FileNotFoundError(f"no payment file below {folder}")
    return union_all(parts)


def payment_load(payments: DataFrame, as_of: date) -> DataFrame:
    """Load rows: whole values of the month of ``as_of`` or later, each payment of a file once."""
    payments = payments.dropDuplicates(["obligacion", "fecha", "valor_decimal", "origen"])
    whole = payments.withColumn("valor", F.col("valor_decimal").try_cast("bigint")).filter("valor > 0")
    return p.from_month(whole, "fecha", as_of).select(
        "obligacion", F.lit("").alias("identificacion"), "fecha", "valor", F.lit("").alias("asesor")
    )


def payment_detail(payments: DataFrame) -> DataFrame:
    """Each obligation, date and value once, whatever file it came from."""
    return dedup(payments, ["obligacion", "fecha", "valor_decimal"], ["origen"])


def unapplied_payments(df: DataFrame, file_day: str = "fecha_archivo", least: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Account counts, accounts to exclude and single payments of unapplied payments.

    With ``least`` the outputs hold rows only when more than so many rows remain.
    """
    rows = p.resolve_aliases(
        df, fixed.UNAPPLIED_ALIASES | {"ARCHIVO": ("archivo",), "FILE_DATE": (file_day,)}
    ).withColumns(
        {
            "CUENTA": accounts.last_nine("CUENTA"),
            "VALOR": amounts.decimal_comma("VALOR"),
        }
    ).filter(F.col("CUENTA").rlike("^[0-9]+$"))
    daily = dedup(rows, ["CUENTA", "FILE_DATE"], ["VALOR", "ARCHIVO"])
    enough = daily.agg(F.count("*") > least).scalar() if least else F.lit(True)
    counts = account_counts(daily, "CUENTA", "FILE_DATE").filter(enough)
    singles = dedup(daily, ["CUENTA", "VALOR"], ["FILE_DATE", "ARCHIVO"]).filter(enough)
    return counts, counts.select("CUENTA"), singles.select("CUENTA", "VALOR", "FILE_DATE")


def no_management(df: DataFrame, account: str, file_day: str) -> DataFrame:
    """Days on which each numeric account was listed as not managed."""
    rows = df.select(accounts.without_points(account).alias("CUENTA"), F.col(file_day).alias("FECHA"))
    return account_counts(rows.filter(F.col("CUENTA").rlike("^[0-9]+$")), "CUENTA", "FECHA")


def brand_payments(df: DataFrame, path: str, key: str = "Marca") -> None:
    """Payments in the fixed column layout, one output folder per brand."""
    write_by_key(df, key, path, fixed.BRAND_PAYMENT_COLUMNS)


def two_column_files(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """Only files with exactly two columns are no-management lists."""
    return [table for table in tables if len(table.columns) == 2]


def ranking(tables: Sequence[DataFrame], agency: str) -> DataFrame:
    """Ranking rows of one agency with services, kind and work state.

    A services column marks fixed-line files; mobile files count rows per account.
    """
    parts = []
    for table in tables:
        headed = p.normalise_headers(table, "word")
        optional = ("servicios", "pago", "fecha", "concepto", "estado")
        fixed_line = "nservicios" in headed.columns
        rows = p.resolve_aliases(headed, fixed.RANKING_ALIASES, optional).filter(
            F.lower(text("agencia")).contains(agency.lower())
        ).withColumn(
            "cuenta", F.translate(accounts.without_zero_decimal(F.trim(text("cuenta"))), ".", "")
        )
        if not fixed_line:
            rows = with_group_stats(rows.drop("servicios"), ["cuenta"], servicios=F.count("*"))
        state = F.coalesce(text("estado"), text("concepto"))
        kind = F.lit("fija" if fixed_line else "movil")
        parts.append(
            rows.select(
                F.col("cuenta").alias("CUENTA"),
                text("servicios").alias("SERVICIOS"),
                classes.ranking_state(state, kind).alias("ESTADO"),
                F.coalesce(text("pago").try_cast("bigint"), F.lit(0)).alias("PAGO"),
                text("fecha").alias("FECHA"),
                text("concepto").alias("CONCEPTO"),
            )
        )
    return union_all(parts).distinct()


def ranking_load(detail: DataFrame) -> DataFrame:
    return detail.select("CUENTA", "SERVICIOS", "ESTADO").distinct()
