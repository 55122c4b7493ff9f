"""Exclusions, dialer and bot results, contact lake, vendor facts and small jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlake.functions import accounts, classes, contacts, dates
from dunlake.functions import fixed_values as fixed
from dunlake.functions.amounts import decimal_comma
from dunlake.functions.base import ColumnLike, text
from dunlake.operators import aggregates as a
from dunlake.operators import joins
from dunlake.operators import projection as p
from dunlake.operators.dedup import dedup
from dunlake.operators.reshape import items_per_key
from dunlake.operators.search import search, search_summary
from dunlake.operators.unions import union_all, upsert_contacts
from dunlake.sources.folders import read_text_files


def exclusion_lists(df: DataFrame, entities: Mapping[str, str]) -> DataFrame:
    """Distinct cleaned values per entity (documento, cuenta, telefono or correo), to be written by entity."""
    parts = []
    for entity, name in entities.items():
        plain = F.regexp_replace(text(F.col(name)), "[ <>]", "")
        value = plain if entity == "correo" else accounts.digits_only(plain)
        parts.append(df.select(F.lit(entity).alias("entidad"), value.alias("valor")))
    return union_all(parts).filter(F.col("valor") != "").distinct()


def exclusion_sources(
    phones: DataFrame, pairs: DataFrame, documents: DataFrame, emails: DataFrame
) -> DataFrame:
    """Exclusions from several lists: phones, landline pairs (area, numero), documents and e-mails."""
    def part(df: DataFrame, entity: str, value: Column) -> DataFrame:
        return df.select(F.lit(entity).alias("entidad"), value.alias("valor"))

    rows = union_all(
        [
            part(phones, "telefono", contacts.exclusion_digits("telefono", 12)),
            part(pairs, "telefono", contacts.landline_from_pair("area", "numero")),
            part(documents, "documento", contacts.exclusion_digits("documento")),
            part(emails, "correo", contacts.exclusion_email("correo")),
        ]
    )
    return rows.filter("valor IS NOT NULL").distinct()


def complaint_exclusion(df: DataFrame, account: str, profiles: Sequence[str], as_of: date) -> DataFrame:
    return p.all_profiles_equal(df, account, profiles, fixed.COMPLAINT_PROFILE, as_of)


def dialer_result(df: DataFrame) -> DataFrame:
    """Result rows of the predictive dialer.

    Input: last_local_call_time, status, vendor_lead_code, phone_number, address1.
    """
    columns = ["last_local_call_time", "status", "vendor_lead_code", "phone_number", "address1"]
    rows = p.conform(df, columns).distinct()
    return rows.select(
        F.lit("No contacto").alias("gestion"),
        F.lit("Predictivo").alias("usuario"),
        dates.day_part(dates.plain_timestamp("last_local_call_time")).alias("fechagestion"),
        F.lit("Hacer llamada").alias("accion"),
        classes.dialer_profile("status").alias("perfil"),
        F.col("phone_number").alias("numeromarcado"),
        F.col("vendor_lead_code").alias("identificacion"),
        F.col("address1").alias("cuenta_promesa"),
        classes.dialer_effect("status", "address1").alias("Filtro_BATCH"),
        classes.dialer_text("status").alias("TIPOLOGIA"),
        accounts.composite_key("phone_number", "vendor_lead_code", separator="").alias("CRUCE"),
    )


def batch_cross(results: DataFrame, lake: DataFrame, want: bool = True) -> DataFrame:
    """Ineffective calls that have (or lack) a contact of a current brand; the account comes from the contact."""
    calls = results.filter(F.col("Filtro_BATCH") == "No efectivo").drop("cuenta_promesa")
    current = lake.filter(~F.col("marca").isin(*fixed.OLD_BRANDS)).select(
        accounts.composite_key("dato", "identificacion", separator="").alias("CRUCE"),
        F.col("cuenta").alias("cuenta_promesa"),
    ).distinct()
    if not want:
        return calls.join(current, "CRUCE", "left_anti").withColumn("cuenta_promesa", F.lit(None).cast("string")).distinct()
    return calls.join(current, "CRUCE", "inner").distinct()


def bot_result(df: DataFrame, order: Sequence[ColumnLike]) -> DataFrame:
    """Bot results, one per phone, account and disposition, with main filter and typology."""
    columns = ["phone", "CUENTA", "disposition", "ans_validacion_identidad", "ans_validacion_pago", "attempts", "duration"]
    rows = p.conform(df, columns) if not set(columns) <= set(df.columns) else df
    single = dedup(rows, ["phone", "CUENTA", "disposition"], order)
    return single.select(
        classes.bot_main_filter("disposition", "ans_validacion_pago").alias("FILTRO__PRINCIPAL"),
        F.col("phone").alias("TELEFONO"),
        "CUENTA",
        classes.bot_typology("disposition", "ans_validacion_identidad", "ans_validacion_pago").alias("TIPOLOGIA"),
        F.col("ans_validacion_identidad").alias("FILTRO_IDENTIDAD"),
        F.col("ans_validacion_pago").alias("FILTRO_PAGO"),
    )


def lake_update(lake: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updated contact lake and its count per contact type."""
    updated = upsert_contacts(lake, new)
    return updated, a.type_counts(updated, "type")


def lake_new_records(new: DataFrame, lake: DataFrame) -> DataFrame:
    """Cleaned, usable contacts that the lake does not hold yet."""
    typed = new.select(
        "document",
        "account",
        contacts.clean_contact("demographic").alias("demographic"),
        contacts.contact_type("demographic").alias("type"),
    ).filter(F.col("type") != "errado")
    return joins.new_only(typed, lake, ["account", "demographic"]).distinct()


def vendor_facts(
    tables: Sequence[tuple[DataFrame, a.VolumeSpec]],
    own_name: str | None = None,
    own_source: str | None = None,
    own_group: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Daily invoicing fact and hourly campaign fact of all vendor reports."""
    daily = [a.daily_volume(table, spec) for table, spec in tables]
    hourly = [a.hourly_volume(table, spec) for table, spec in tables]
    names = (own_name, own_source, own_group)
    return a.volume_fact(daily, *names), a.volume_fact(hourly, *names)


def sent_bucket_summary(df: DataFrame, bucket: str, file: str, kind: str, campaign: str) -> DataFrame:
    """Messages per file and bucket with date and time read from the file name."""
    counted = a.bucket_counts(df, bucket, [file])
    return counted.select(
        F.col(file).alias("Archivo"),
        dates.file_name_date(file).cast("string").alias("Fecha"),
        dates.file_name_time(file).alias("Hora"),
        "Mora",
        F.lit(kind).alias("Tipo"),
        "Cantidad",
        F.lit(campaign).alias("Campana"),
    )


def agent_time(df: DataFrame, as_of: date) -> DataFrame:
    """Agent time report with all columns present, renamed, and stamped with the day before."""
    complete = df.withColumns({c: F.lit("") for c in fixed.AGENT_TIME_COLUMNS if c not in df.columns})
    names = {old: new for old, new in fixed.AGENT_TIME_RENAMES.items() if new not in df.columns}
    stamp = (as_of - timedelta(days=1)).strftime("%d/%m/%Y")
    return p.rename(complete, names).withColumn("Fecha", F.lit(stamp))


def dashboard(df: DataFrame, as_of: date) -> DataFrame:
    """Sent messages in the dashboard schema.

    The two segment replacements follow each other, so a plural becomes 'PERSONASS'
    as in the tables the dashboard already holds.
    """
    segment = F.replace(F.upper(p.pick(df, ["SEGMENTO"], required=False)), F.lit("NO APLICA"), F.lit("PERSONAS"))
    derived = {
        "Cuenta_Next": accounts.without_dashes(p.pick(df, ["CUENTA"], required=False)),
        "Cuenta": accounts.without_dashes(p.pick(df, ["CUENTA_REAL"], required=False)),
        "CRM": classes.origin_label(p.pick(df, ["PRODUCTO"], required=False), "dashboard"),
        "Saldo_Asignado": decimal_comma(p.pick(df, ["MOD_INIT_CTA"], required=False)),
        "DEUDA_REAL": decimal_comma(p.pick(df, ["VALOR_DE_PAGAR"], required=False)),
        "Hora_Envio": dates.hour_part(p.pick(df, ["HORA_EJECUCION"], required=False)),
        "Segmento": F.replace(segment, F.lit("PERSONA"), F.lit("PERSONAS")),
    }
    literals = {
        "Fecha_Asignacion": as_of.strftime("%Y-%m"),
        "fechapromesa": "Desconocida",
        "RANKING STATUS": "Dinámico",
        "CANTIDAD SERVICIOS": "0",
    }
    return p.map_schema(df, fixed.DASHBOARD_TARGET, fixed.DASHBOARD_SOURCES, literals, derived)


def demographics_union(tables: Sequence[DataFrame], order: Sequence[ColumnLike] = ("identificacion",)) -> DataFrame:
    """Demographic files in one table, each account and contact once."""
    return dedup(union_all(tables), ["cuenta", "dato"], order)


def accounts_per_document(df: DataFrame) -> DataFrame:
    """Accounts of the listed brands of each document as one text."""
    rows = df.filter(F.col("marca").isin(*fixed.LISTED_BRANDS))
    item = F.concat(accounts.without_dashes("cuenta"), F.lit("_"))
    return items_per_key(rows, "identificacion", item, "Cuentas")


def login_log(df: DataFrame) -> DataFrame:
    """First entry, last exit and plain day of the agent login log."""
    return df.withColumns(
        {
            "usuhorasalida": dates.last_item("usuhorasalida"),
            "fecha": dates.day_part("fecha"),
            "usuhoraentrada": dates.first_item("usuhoraentrada"),
        }
    )


def search_folder(spark: SparkSession, folder: str, terms: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a folder's text files holding a term in any column, with their file, and the hits per term."""
    rows = read_text_files(spark, folder, "*.csv", recursive=True, origin="Origen_Archivo")
    hits = search(rows, terms, [c for c in rows.columns if c != "Origen_Archivo"])
    return hits, search_summary(hits, terms, "Origen_Archivo")
