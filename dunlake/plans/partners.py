"""Partner bases: one pipeline, one parameter record per partner."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions import amounts, bands, contacts, dates, names
from dunlake.functions import fixed_values as fixed
from dunlake.operators import projection as p
from dunlake.operators.dedup import dedup
from dunlake.operators.reshape import explode_list, unpivot_slots

CONTACT = "Dato_Contacto"


@dataclass(frozen=True)
class PartnerSpec:
    """Column names and rules in which the partner files differ."""

    account: str
    document: str
    name: str
    price: str
    entry_date: str | None = None
    contacts: Sequence[str] = ()
    list_cell: str | None = None
    list_separator: str = r"\|"
    kind: str = "both"
    emails: Sequence[str] = ()
    email_cell: str | None = None
    profiles: Sequence[str] = ()
    unpaid_column: str | None = None
    kept: Sequence[str] = ()


def partner_base(df: DataFrame, spec: PartnerSpec, as_of: date, emails: bool = False) -> DataFrame:
    """Phones or e-mails of a partner's accounts with band, money text, days since entry and short name.

    Contacts come from slot columns, from a delimited list cell, or from both.
    """
    if emails:
        spec = replace(spec, contacts=spec.emails, list_cell=spec.email_cell, list_separator=r"\|", kind="email")
    base = p.exclude_profiles(df, spec.profiles) if spec.profiles else df
    if spec.unpaid_column is not None:
        base = base.filter(F.col(spec.unpaid_column).isNull())
    # The costly name cleaning runs once per account, the rest once per kept contact.
    base = base.withColumn("_name", names.clean_name(spec.name))
    slots = [c for c in spec.contacts if c in df.columns]
    if spec.list_cell is not None:
        base = explode_list(base, spec.list_cell, "_item", spec.list_separator)
        slots.append("_item")
    rows = unpivot_slots(base, slots, CONTACT, keep_nulls=False, distinct=True)
    valid = rows.filter(contacts.contact_filter(CONTACT, spec.kind))
    single = dedup(valid, [spec.account, CONTACT], [spec.document]).withColumns(
        {
            "Rango": bands.debt_band(spec.price),
            "precio": amounts.truncated(spec.price),
            "NOMBRE CORTO": names.short_name("_name"),
        }
    )
    days = (
        dates.days_past_due(dates.parsed_date(spec.entry_date), as_of)
        if spec.entry_date is not None
        else F.lit(None).cast("int")
    )
    return single.select(
        F.col(spec.account).alias("cuenta"),
        F.col(spec.document).alias("identificacion"),
        CONTACT,
        "Rango",
        "precio",
        amounts.money_text("precio").alias("Form_Moneda"),
        "NOMBRE CORTO",
        days.alias("dias_transcurridos"),
        *spec.kept,
    )


#: One record a partner; column names are those of their files.
PARTNERS = {name: PartnerSpec(**columns) for name, columns in fixed.PARTNER_FILES.items()}
