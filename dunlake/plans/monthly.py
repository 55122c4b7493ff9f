"""Monthly analytics: demographics, touches and the wide dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions import accounts, amounts, bands, classes, contacts, dates
from dunlake.functions import fixed_values as fixed
from dunlake.operators import joins
from dunlake.operators import projection as p
from dunlake.operators.aggregates import contact_mix, touch_count, touch_matrix
from dunlake.operators.dedup import dedup
from dunlake.operators.regions import map_region
from dunlake.operators.reshape import filled_slots, pivot_slots, slot_names


def _slots(rows: DataFrame, n: int, prefix: str) -> DataFrame:
    # An account has few contacts, so one shuffle by account serves the dedup and the slots.
    single = dedup(rows.repartition("cuenta"), ["cuenta", "dato"], ["identificacion"])
    return pivot_slots(single, ["cuenta", "identificacion"], ["dato"], "dato", n, prefix)


def demographics(
    df: DataFrame, phones: int = fixed.PHONE_SLOTS, emails: int = fixed.EMAIL_SLOTS
) -> DataFrame:
    """Phones and e-mails of each account side by side, with counts and a contact profile.

    Every slot is counted. ``df`` has identificacion, cuenta and dato.
    """
    rows = df.select(
        "identificacion", accounts.guarded(accounts.without_dashes("cuenta")).alias("cuenta"), "dato"
    )
    valid = rows.filter(contacts.contact_filter("dato", landline=fixed.REORDER_LANDLINE_RANGE))
    numbers = _slots(valid, phones, "phone")
    columns = slot_names("phone", phones)
    counted = numbers.withColumns(
        {
            "NumMovil": filled_slots(columns, lambda c: contacts.in_range(c, fixed.MOBILE_RANGE)),
            "NumFijo": filled_slots(columns, lambda c: contacts.in_range(c, fixed.COUNTED_LANDLINE_RANGE)),
        }
    )
    addresses = _slots(rows.filter(contacts.contact_filter("dato", "email")), emails, "email")
    mailed = addresses.withColumn(
        "NumEmail", filled_slots(slot_names("email", emails), lambda c: c.contains("@"))
    )
    merged = joins.merge_contacts(counted, mailed, "cuenta", "identificacion")
    return merged.withColumn("Filtro Demografico", classes.contact_profile("NumMovil", "NumFijo", "NumEmail")).withColumns(
        {name: classes.shown_count(name) for name in ("NumMovil", "NumFijo", "NumEmail")}
    )


def channel_touches(events: Mapping[str, DataFrame]) -> DataFrame:
    """Touch counts of the four channels in one table.

    Each input has cuenta and marca; the e-mail channel drops blank accounts, the
    voice channel counts answered states only (column estado).
    """
    names = {"sms": "Mensajeria", "email": "EMAIL", "bot": "BOT", "ivr": "IVR"}
    parts = []
    for channel, table in events.items():
        rows = table
        if channel == "ivr":
            answered = classes.dialer_text("estado", default=F.col("estado"), predictive=False)
            rows = rows.filter(answered.isin(*fixed.IVR_COUNTED))
        account = classes.touched_account("cuenta")
        brand = accounts.blank_as("marca", "0") if channel == "ivr" else F.col("marca")
        parts.append(touch_count(rows, account, brand, names[channel], drop_zero=channel == "email"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def monthly_touches(channels: Mapping[str, DataFrame], month: str, year: str) -> DataFrame:
    return p.with_constants(touch_matrix(channels), {"MES DE ASIGNACION": month, "PERIODO DE ASIGNACION": year})


def wide_dataset(
    base: DataFrame,
    satellites: Mapping[str, tuple[DataFrame, Sequence[str]]],
    excluded_documents: DataFrame,
    report: DataFrame,
    rules: DataFrame,
    departments: Sequence[str] | None = fixed.DEPARTMENTS,
) -> DataFrame:
    """One wide row per account.

    ``satellites`` are tables keyed by 'CUENTA NEXT' with the order that picks a
    survivor: contacts, touches, assignment data, queues, ranking, excluded accounts,
    unapplied payments, unmanaged days. Their columns reach the result if they are
    named in ``WIDE_GROUPS``. ``report`` has 'CUENTA NEXT' and perfil. All joins but the last use
    the account, so the base is shuffled for them once.
    """
    # The places are mapped first: their distinct values come from the base alone.
    placed = map_region(base, "CIUDAD", rules, departments)
    keyed = placed.withColumn("CUENTA NEXT", accounts.guarded(accounts.without_zero_decimal("CUENTA NEXT")))
    managed = contact_mix(
        report.withColumn("CUENTA NEXT", accounts.guarded(accounts.without_zero_decimal("CUENTA NEXT"))),
        "CUENTA NEXT", "perfil",
    ).withColumnsRenamed(
        {
            "mezcla": "FILTRO REPORTE GESTION",
            "contacto_directo": "contacto directo",
            "contacto_indirecto": "contacto indirecto",
            "no_contacto": "no contacto",
        }
    )
    tables = [
        (table.withColumn("CUENTA NEXT", accounts.guarded(accounts.without_zero_decimal("CUENTA NEXT"))), "CUENTA NEXT", order)
        for table, order in satellites.values()
    ]
    documents = excluded_documents.select("DOCUMENTO").withColumn("EXCLUSION DOCUMENTO", F.lit("APLICA"))
    joined = joins.enrich(
        keyed,
        "CUENTA NEXT",
        ["DOCUMENTO"],
        [*tables, (managed, "CUENTA NEXT", ["contacto directo"]), (documents, "DOCUMENTO", ["EXCLUSION DOCUMENTO"])],
    )
    built = joined.withColumns(
        {
            "RANGO DEUDA": bands.debt_band("SALDO"),
            "RANGO DE DIAS ASIGNADA": bands.day_band("DIAS ASIGNADA"),
            "RANGO DE DIAS RETIRADA": bands.day_band("DIAS RETIRADA"),
            "DIAS MORA": dates.days_between("FECHA INGRESO", "FECHA VENCIMIENTO"),
            "FILTRO DEMOGRAFICOS": classes.contact_profile("NumMovil", "NumFijo", "NumEmail"),
            "CANTIDAD DEMOGRAFICOS": F.col("NumMovil") + F.col("NumFijo") + F.col("NumEmail"),
            "CANTIDAD MOVILES": F.col("NumMovil"),
            "CANTIDAD FIJOS": F.col("NumFijo"),
            "CANTIDAD EMAILS": F.col("NumEmail"),
            "FILTRO DESCUENTO": amounts.discount_flag("PORCENTAJE"),
            "FILTRO PAGOS SIN APLICAR": amounts.counted_flag("RECUENTO PAGOS"),
            "FILTRO NO GESTION": amounts.counted_flag("RECUENTO NO GESTION"),
        }
    ).withColumn("RANGO DE DIAS MORA", bands.overdue_band("DIAS MORA"))
    return p.prefix_groups(p.without_text(built, "FECHA INGRESO", "Manual"), fixed.WIDE_GROUPS)
