"""Campaign bases: SMS, e-mail, IVR, bot and dialer task list."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions import accounts, amounts, bands, classes, contacts, dates, names
from dunlake.functions import fixed_values as fixed
from dunlake.functions.messages import MessageText, message_columns
from dunlake.operators import projection as p
from dunlake.operators.aggregates import brand_retire_flag
from dunlake.operators.dedup import dedup, join_null_safe
from dunlake.operators.reshape import filled_slots, pivot_slots, slot_names, unpivot_slots

PHONE_COLUMNS = (*slot_names("celular", 10), *slot_names("fijo", 3), "min")
EMAIL_COLUMNS = ("email1", "email2")
CONTACT = "Dato_Contacto"


@dataclass(frozen=True)
class CampaignSpec:
    """Which accounts a campaign addresses and on which day it is built."""

    as_of: date
    brands: Sequence[str]
    origins: Sequence[str] = fixed.ORIGINS
    due: str | None = None
    benefit: str | None = None
    contact: str = "both"
    low: float = 0
    high: float = 1e15
    at: time = time(8, 0)


def with_defaults(df: DataFrame, clean_names: bool = True) -> DataFrame:
    """Cleaned names and defaults of a campaign base, with special brands flagged for retirement."""
    name = {"nombrecompleto": names.clean_name("nombrecompleto")} if clean_names else {}
    treated = df.withColumns(
        {
            "cuenta": accounts.without_dashes("cuenta"),
            "cuenta2": accounts.without_dashes("cuenta2"),
            **name,
            "descuento": amounts.plain_discount("descuento"),
            "marca2": classes.second_brand("ciudad", "marca"),
            "tipo_pago": classes.known_payment("tipo_pago"),
            "estado_ranking": classes.known_ranking("estado_ranking"),
            "Tipo Base": classes.base_type("nombre_campana"),
        }
    )
    return brand_retire_flag(treated, "marca", "estado_ranking")


def chosen_accounts(df: DataFrame, spec: CampaignSpec, allow_partial: bool = True, price: str = "Mod_init_cta") -> DataFrame:
    """Account-level filters. They run before contacts are unpivoted, on one row per account."""
    return (
        p.filter_members(df, {"marca": spec.brands, "origen": spec.origins})
        .filter(p.is_open_payment("tipo_pago", allow_partial))
        .filter(p.is_due_on("fecha_vencimiento", spec.due))
        .filter(p.amount_between(price, spec.low, spec.high))
        .filter(p.has_benefit("descuento", spec.benefit))
    )


def contact_rows(df: DataFrame, columns: Sequence[str], spec: CampaignSpec, kind: str | None = None) -> DataFrame:
    """One row per valid contact of an account."""
    present = [c for c in columns if c in df.columns]
    rows = unpivot_slots(df, present, CONTACT, keep_nulls=False, distinct=True)
    return rows.filter(contacts.contact_filter(CONTACT, kind or spec.contact))


def one_per_contact(df: DataFrame) -> DataFrame:
    return dedup(df, ["cuenta", CONTACT], ["identificacion", "cuenta2"])


def sms_base(
    df: DataFrame, spec: CampaignSpec, phones: Sequence[str] = PHONE_COLUMNS, texts: Sequence[MessageText] = ()
) -> DataFrame:
    """Mobile contacts with amount texts, message fields and one column per message text.

    The band uses the amount before discount. Account columns that ``df`` lacks are null.
    """
    base = chosen_accounts(with_defaults(df), spec)
    # Derived columns come after the dedup: they need not be shuffled with every contact.
    rows = one_per_contact(contact_rows(base, phones, spec, "mobile")).withColumns(
        {
            "DEUDA_REAL": amounts.truncated("Mod_init_cta"),
            "Rango": bands.debt_band("Mod_init_cta"),
            "Mod_init_cta": amounts.discounted("Mod_init_cta", "descuento"),
            "referencia": F.when(F.col("origen") == "RR", F.col("cuenta")).otherwise(F.col("referencia")),
            "PRODUCTO": classes.origin_label("origen", "sms"),
            "NOMBRE CORTO": names.short_name("nombrecompleto"),
            "dias_transcurridos": dates.days_past_due(dates.slash_date("fecha_vencimiento"), spec.as_of),
        }
    )
    base_rows = rows.select(
        "identificacion",
        accounts.guarded("cuenta").alias("cuenta"),
        accounts.guarded("cuenta2").alias("cuenta2"),
        *[p.pick(rows, [c], required=False).alias(c) for c in fixed.SMS_ACCOUNT_COLUMNS],
        F.lit(spec.at.strftime("%H")).alias("Hora_Envio"),
        F.lit(spec.at.strftime("%H:%M")).alias("Hora_Real"),
        "marca",
        "marca2",
        "origen",
        "Mod_init_cta",
        amounts.money_text("Mod_init_cta").alias("Form_Moneda"),
        "nombrecompleto",
        "Rango",
        "referencia",
        CONTACT,
        "descuento",
        "DEUDA_REAL",
        "PRODUCTO",
        "tipo_pago",
        "estado_ranking",
        "Tipo Base",
        "dias_transcurridos",
        "NOMBRE CORTO",
        accounts.reference_flag("referencia").alias("FILTRO_REFERENCIA"),
        F.lit(spec.as_of.strftime("%d/%m/%Y")).alias("Fecha_Hoy"),
    )
    return base_rows.withColumns(message_columns(texts, "origen", base_rows.columns)) if texts else base_rows


def email_base(df: DataFrame, spec: CampaignSpec, emails: Sequence[str] = EMAIL_COLUMNS) -> DataFrame:
    """Usable e-mail addresses with a dispatch flag."""
    base = chosen_accounts(with_defaults(df), spec)
    rows = unpivot_slots(base, list(emails), CONTACT, keep_nulls=False, distinct=True)
    known = one_per_contact(rows.filter((F.col(CONTACT) != "0") & (F.col(CONTACT) != "")))
    priced = known.withColumns(
        {
            "Rango": bands.debt_band("Mod_init_cta"),
            "Mod_init_cta": amounts.discounted("Mod_init_cta", "descuento"),
            "referencia": F.when(F.col("origen") == "RR", F.col("cuenta")).otherwise(F.col("referencia")),
        }
    )
    cleaned = (
        priced.withColumn("Canal", contacts.email_channel(CONTACT))
        .withColumn(CONTACT, contacts.clean_email(CONTACT))
        .filter(F.col(CONTACT) != "0")
        .withColumn("FILTRO_REFERENCIA", accounts.reference_flag("referencia"))
    )
    return cleaned.select(
        "Canal",
        CONTACT,
        "descuento",
        F.col("marca").alias("Edad_Mora"),
        classes.origin_label("origen", "email").alias("CRM"),
        amounts.money_text("Mod_init_cta", ",").alias("Form_Moneda"),
        F.col("nombrecompleto").alias("Nombre_Completo"),
        F.col("referencia").alias("Referencia"),
        F.col("cuenta2").alias("Cuenta"),
        "marca2",
        "plan",
        "identificacion",
        "tipo_pago",
        "FILTRO_REFERENCIA",
        "Rango",
        F.col("estado_ranking").alias("RANKING STATUS"),
        classes.dispatch_flag("nombrecompleto", "Canal", "FILTRO_REFERENCIA").alias("FILTRO GENERAL"),
        "Tipo Base",
    )


def ivr_base(df: DataFrame, spec: CampaignSpec, layout: str = "standard", phones: Sequence[str] = PHONE_COLUMNS) -> DataFrame:
    """Phone contacts for the voice dialer; partial payers are left out."""
    base = chosen_accounts(with_defaults(df), spec, allow_partial=False)
    rows = one_per_contact(contact_rows(base, phones, spec)).withColumns(
        {
            "Mod_init_cta": amounts.discounted("Mod_init_cta", "descuento"),
            "corto": names.short_name("nombrecompleto"),
            "dias": dates.days_past_due(dates.slash_date("fecha_vencimiento"), spec.as_of),
            "linea": contacts.line_type(CONTACT),
        }
    )
    return p.rename(rows, fixed.IVR_LAYOUTS[layout], only_mapped=True)


BOT_LAYOUTS = ("full", "short", "personal")


def bot_base(df: DataFrame, spec: CampaignSpec, layout: str = "full", phones: Sequence[str] = PHONE_COLUMNS) -> DataFrame:
    """Contacts for the voice bots. The discount is applied once, before the amount filter."""
    if layout not in BOT_LAYOUTS:
        raise ValueError(f"unknown bot layout {layout!r}")
    priced = with_defaults(df).withColumn("Mod_init_cta", amounts.discounted("Mod_init_cta", "descuento"))
    base = chosen_accounts(priced, spec)
    rows = one_per_contact(contact_rows(base, phones, spec, "mobile" if layout == "personal" else None)).withColumns(
        {
            "Referencia": accounts.reference_number("origen", "cuenta", "referencia"),
            "dias": dates.days_past_due(dates.slash_date("fecha_vencimiento"), spec.as_of),
            "CRM": classes.origin_label("origen", "bot"),
        }
    )
    dialed = contacts.with_country_code(CONTACT)
    if layout == "short":
        return rows.select(
            dialed.alias("phone"),
            names.short_name("nombrecompleto").alias("name"),
            F.col("Mod_init_cta").alias("debtamount"),
            F.col("dias").alias("debtdays"),
            F.lit("pesos").alias("currency"),
            F.col("identificacion").alias("document"),
            F.col("cuenta").alias("CUENTA"),
            F.col("marca").alias("Edad de Mora"),
            F.col("origen").alias("origin"),
            F.col("cuenta2").alias("CUENTA_NEXT"),
            F.col("fecha_vencimiento").alias("FLP"),
        )
    personal = layout == "personal"
    return rows.select(
        F.col("marca").alias("NOMBRE CAMPANA"),
        F.col("identificacion").alias("IDENTIFICACION"),
        names.given_names("nombrecompleto").alias("NOMBRE COMPLETO"),
        names.surnames("nombrecompleto").alias("APELLIDO COMPLETO"),
        (dialed if personal else F.col(CONTACT)).alias("CELULAR"),
        F.col("Mod_init_cta").alias("MONTO"),
        (F.col("Tipo Base") if personal else F.col("CRM")).alias("MARCA"),
        classes.origin_state("origen").alias("ESTADO"),
        F.col("dias").alias("DIAS MORA"),
        (F.lit("Mensaje Personalizado") if personal else classes.box_code("origen")).alias("CAJA"),
        F.col("cuenta"),
        F.col("cuenta2").alias("CUENTA_NEXT"),
        F.col("descuento").alias("DESCUENTO"),
        F.col("Referencia").alias("REFERENCIA"),
        F.lit(spec.as_of.isoformat()).alias("FECHA PLAZO"),
    )


def task_base(
    df: DataFrame, spec: CampaignSpec, phones: Sequence[str] = PHONE_COLUMNS, slots: int = fixed.TASK_SLOTS
) -> DataFrame:
    """Dialer task list of accounts with a reference: each phone once, up to nine phones per document on one row."""
    reference = F.when(F.col("origen") == "RR", F.col("cuenta")).otherwise(F.col("referencia"))
    base = chosen_accounts(with_defaults(df), spec).filter(
        p.not_contacted_on("fechagestion_contactodirecto", spec.as_of) & (reference != "")
    )
    rows = contact_rows(base, phones, spec)
    single = dedup(rows, [CONTACT], ["identificacion", "cuenta"])
    kept = ["cuenta", "cuenta2", "origen", "marca", "marca2", "Mod_init_cta", "descuento", "tipo_pago", "fecha_vencimiento"]
    wide = pivot_slots(single, ["identificacion"], ["cuenta", CONTACT], CONTACT, slots, "phone", kept)
    return wide.withColumns(
        {
            "Mod_init_cta": amounts.truncated("Mod_init_cta"),
            "dias_transcurridos": dates.days_past_due(dates.slash_date("fecha_vencimiento"), spec.as_of),
        }
    )


def reorder_base(
    df: DataFrame, phones: Sequence[str], slots: int = fixed.REORDER_SLOTS, excluded_brand: str = "castigo"
) -> DataFrame:
    """Wide contact table per account with counts, ordered by the kind of contact in each slot."""
    base = with_defaults(df, clean_names=False).filter(F.col("marca") != excluded_brand)
    keys = ["cuenta", "identificacion"]
    slot_columns = [c for c in phones if c in df.columns]
    rows = unpivot_slots(base.select(*keys, *slot_columns), slot_columns, CONTACT, keep_nulls=False, distinct=True)
    # An account has few contacts, so one shuffle by account serves the dedup and the slots.
    valid = dedup(
        rows.filter(contacts.contact_filter(CONTACT, landline=fixed.REORDER_LANDLINE_RANGE)).repartition("cuenta"),
        ["cuenta", CONTACT],
        ["identificacion"],
    )
    # Only keys and contacts are multiplied and shuffled; the account fields join back once.
    kept = ["cuenta2", "marca", "marca2", "origen", "Mod_init_cta", "nombrecompleto", "referencia", "descuento", "Tipo Base"]
    fields = dedup(base.select(*keys, *kept), keys, kept).withColumn("nombrecompleto", names.clean_name("nombrecompleto"))
    wide = join_null_safe(pivot_slots(valid, keys, [CONTACT], CONTACT, slots, "phone"), fields, keys, "left")
    columns = slot_names("phone", slots)
    counted = wide.withColumns(
        {
            "Mod_init_cta": amounts.discounted("Mod_init_cta", "descuento"),
            "No.Movil": filled_slots(columns, lambda c: contacts.in_range(c, fixed.MOBILE_RANGE)),
            "No.Fijo": filled_slots(columns, lambda c: contacts.in_range(c, fixed.COUNTED_LANDLINE_RANGE)),
            "orden_contacto": contacts.slot_signature(columns),
        }
    )
    return counted.withColumns(
        {
            "MOVIL": F.when(F.col("`No.Movil`") > 0, "SI TIENE").otherwise("NO TIENE"),
            "FIJO": F.when(F.col("`No.Fijo`") > 0, "SI TIENE").otherwise("NO TIENE"),
        }
    )
