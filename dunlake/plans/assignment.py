"""Assignment jobs: monthly structuring, load files and contacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions import accounts, amounts, bands, classes, contacts, dates, names
from dunlake.functions import fixed_values as fixed
from dunlake.operators import joins
from dunlake.operators import projection as p
from dunlake.operators.aggregates import multi_flags
from dunlake.operators.calendar import calendar, calendar_summary
from dunlake.operators.dedup import dedup
from dunlake.operators.reshape import unpivot_slots
from dunlake.session import store

# Position columns of the assignment file by meaning.
POSITIONS = {
    "documento": "1_",
    "cuenta": "2_",
    "origen": "3_",
    "marca5": "5_",
    "marca6": "6_",
    "marca7": "7_",
    "deuda": "9_",
    "campana": "12_",
    "edad": "13_",
    "ciudad": "22_",
    "nombre": "24_",
    "corrida": "25_",
    "vencimiento": "26_",
    "referencia": "27_",
    "linea": "28_",
    "tipo_cliente": "41_",
    "refinanciada": "42_",
    "dia": "62_",
}


def by_meaning(df: DataFrame, positions: Mapping[str, str] = POSITIONS) -> DataFrame:
    """Meaningful names for the position columns, at the edge of the job."""
    return p.rename(df, {old: new for new, old in positions.items()}, only_mapped=True)


def structured_assignment(
    df: DataFrame, discounts: DataFrame, month: str, code: str = "CUENTA", percent: str = "PORCENTAJE"
) -> DataFrame:
    """One row per account of a month: classes, calendar, discount and multi-account flags.

    ``df`` has one row per account and assigned day, with the columns of ``POSITIONS``.
    """
    titled = p.drop_header_rows(df, "origen", "CRM Origen")
    day = dates.slash_date("dia")
    dated = titled.withColumn("_day", F.dayofmonth(day))
    summary = calendar_summary(calendar(dated, "cuenta", "_day"), month).drop("primer_dia", "ultimo_dia")
    first = dedup(dated, ["cuenta"], ["_day", "documento"])
    single = first.join(summary, "cuenta", "left").select(
        accounts.digits_only("documento").alias("DOCUMENTO"),
        classes.document_type("documento").alias("TIPO DE DOCUMENTO"),
        accounts.guarded("cuenta").alias("CUENTA"),
        accounts.guarded(accounts.without_points("cuenta")).alias("CUENTA_NEXT"),
        classes.assign_brand(
            "origen", "marca5", "marca6", "marca7", "refinanciada", "edad", "campana"
        ).alias("MARCA"),
        F.col("origen").alias("CRM"),
        classes.segment("tipo_cliente").alias("SEGMENTO"),
        F.col("deuda").try_cast("double").alias("VALOR DEUDA"),
        bands.debt_band("deuda").alias("RANGO DEUDA"),
        F.when(F.col("origen") == "RR", F.col("cuenta"))
        .otherwise(accounts.default_reference("referencia", "origen"))
        .alias("REFERENCIA"),
        names.clean_name("nombre").alias("NOMBRE"),
        F.col("dias_asignada").alias("DIAS ASIGNADA"),
        F.col("dias_retirada").alias("DIAS RETIRADA"),
        F.col("rango_de_dias").alias("RANGO DE DIAS"),
        F.col("grupo_rango_de_dias").alias("GRUPO RANGO DE DIAS"),
        F.col("fecha_ingreso").alias("FECHA INGRESO"),
        F.col("fecha_retiro").alias("FECHA RETIRO"),
        F.col("estado_cuenta").alias("ESTADO CUENTA"),
        "dias",
    )
    priced = joins.apply_discount(single, discounts, "CUENTA_NEXT", code, percent)
    reduced = priced.withColumn("VALOR DESCUENTO", amounts.discounted_or_zero("VALOR DEUDA", percent)).withColumn(
        "RANGO CON DESCUENTO", bands.discount_band("VALOR DESCUENTO")
    )
    # The flags read these rows twice; written once, they are not computed twice.
    flagged = multi_flags(store(reduced, "assignment"), "DOCUMENTO", "CRM", "MARCA")
    return flagged.withColumn("FILTRO REFERENCIA", accounts.reference_flag_by_length("REFERENCIA"))


def load_file(df: DataFrame, order: Sequence[str] = ("documento",)) -> DataFrame:
    """Load rows of the assignment, labelled with every route they belong to.

    Routes: cargue (valid rows), multimarca (without write-offs), actualizacion (the
    update view of those) and errores. One pass feeds all outputs.
    """
    origins = df.filter(F.col("origen").isin(*fixed.ORIGINS))
    single = dedup(origins, ["cuenta"], order).withColumns(
        {
            "refinanciada": classes.refinance_mark("refinanciada", "marca5", "marca6", "marca7"),
            "nombre_limpio": names.clean_name_literal("nombre"),
        }
    )
    named = single.withColumn("nombre", names.cleaned_or_original("nombre_limpio", "nombre")).drop("nombre_limpio")
    typed = named.withColumn("tipo_documento", classes.document_type("documento"))
    valid = p.validity("tipo_cliente", "corrida", "referencia")
    branded = valid & (F.col("marca7") != "Y")
    rows = p.routed(typed, {"cargue": valid, "multimarca": branded, "actualizacion": branded, "errores": ~valid})
    update = F.col("ruta") == "actualizacion"
    return rows.withColumns(
        {
            "cliente": F.when(update, accounts.client_number("documento", "cuenta")).otherwise(F.col("documento")),
            "cuenta": F.when(update, accounts.without_points("cuenta")).otherwise(F.col("cuenta")),
            "vencimiento": F.when(update, dates.slash_date("vencimiento").cast("string")).otherwise(
                F.col("vencimiento")
            ),
        }
    )


def create_file(df: DataFrame, lines: Sequence[str], order: Sequence[str] = ("documento",)) -> DataFrame:
    """Account rows for creation with brand, band and line list; routed by company, brand and write-off."""
    rows = dedup(df.filter(F.col("origen").isin(*fixed.ORIGINS)), ["cuenta"], order)
    built = rows.select(
        "cuenta",
        accounts.without_points("cuenta").alias("cuenta_next"),
        "origen",
        accounts.joined_lines(*lines).alias("lineas"),
        classes.assign_brand("origen", "marca5", "marca6", "marca7", "refinanciada", "edad", "campana").alias("marca"),
        classes.segment("tipo_cliente").alias("segmento"),
        bands.debt_band("deuda").alias("rango"),
        amounts.decimal_comma("deuda").alias("saldo"),
        classes.base_type("campana").alias("tipo_base"),
        classes.document_type("documento").alias("tipo_documento"),
    )
    corporate = F.col("tipo_base") == "CLIENTES CORPORATIVOS"
    written_off = F.col("marca") == "Castigo"
    return p.routed(
        built,
        {
            "multiorigen": F.lit(True),
            "corporativos": corporate,
            "multimarca": ~written_off & ~corporate,
            "castigo": written_off,
            "con_origen": F.col("origen").isNotNull(),
        },
    )


def assignment_contacts(
    df: DataFrame, phones: Sequence[str], emails: Sequence[str], place: str = "ciudad", brand: str = "marca"
) -> DataFrame:
    """Contacts of an assignment: valid phones, rebuilt landlines and usable e-mails, each once per account."""
    base = df.withColumn("identificacion", accounts.digits_only("identificacion").try_cast("bigint")).filter(
        F.col("identificacion").isNotNull()
    )
    slots = unpivot_slots(
        base.select("identificacion", "cuenta", place, brand, *phones), list(phones), "dato", keep_nulls=False, distinct=True
    )
    numbers = slots.withColumn("dato", contacts.strip_contact_key(contacts.mark_placeholder("dato")))
    in_lake = contacts.contact_filter("dato", "both", fixed.LAKE_MOBILE_RANGE, fixed.LAKE_LANDLINE_RANGE)
    chosen = F.coalesce(F.when(in_lake, F.col("dato")), contacts.rebuild_landline("dato", place))
    valid = numbers.withColumn("dato", chosen).filter("dato IS NOT NULL").withColumn("tipodato", F.lit("telefono"))
    addresses = unpivot_slots(
        base.select("identificacion", "cuenta", place, brand, *emails), list(emails), "dato", keep_nulls=False, distinct=True
    )
    usable = addresses.filter(
        F.contains("dato", F.lit("@")) & (contacts.email_quality("dato") != "ERRADO")
    ).select(
        "identificacion", "cuenta", place, brand, F.lower("dato").alias("dato"), F.lit("email").alias("tipodato")
    )
    rows = valid.unionByName(usable)
    return dedup(rows, ["cuenta", "dato"], ["identificacion"]).withColumn("cuenta", accounts.without_points("cuenta"))
