"""Message texts with (FIELD) placeholders."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlake.functions.base import ColumnLike, as_column, text

_PLACEHOLDER = re.compile(r"(\([^)]+\))")


def fill_template(template: str, columns: Sequence[str]) -> Column:
    """Concatenate the template's texts and columns; an unknown field is an error.

    The template is split once on the driver. Column names match without case,
    and a null field is written as blank.
    """
    known = {name.upper(): name for name in columns}
    pieces: list[Column] = []
    for part in _PLACEHOLDER.split(template):
        if _PLACEHOLDER.fullmatch(part):
            name = known.get(part[1:-1].upper())
            if name is None:
                raise ValueError(f"no column for placeholder {part}")
            pieces.append(F.coalesce(text(F.col(f"`{name}`")), F.lit("")))
        elif part.strip():
            pieces.append(F.lit(part))
    return F.concat(*pieces) if pieces else F.lit("")


@dataclass(frozen=True)
class MessageText:
    """One text: a default wording, wordings per origin, and a field that must be present."""

    name: str
    default: str
    by_origin: Mapping[str, str] = field(default_factory=dict)
    required: str | None = None


# Own wordings; deployments pass theirs.
SAMPLE_TEXTS = (
    MessageText(
        "mensaje_1",
        "Su saldo es (Form_Moneda) con referencia (referencia).",
        {"ASCARD": "La cuota de su (PRODUCTO) es (Form_Moneda), referencia (referencia)."},
    ),
    MessageText(
        "mensaje_2",
        "(NOMBRE_CORTO), pague hoy (Form_Moneda) y mantenga activo su servicio (PRODUCTO).",
    ),
    MessageText(
        "mensaje_3",
        "(NOMBRE_CORTO), tiene un descuento del (descuento) sobre (Form_Moneda).",
        required="descuento",
    ),
)


def message_columns(
    texts: Sequence[MessageText], origin: ColumnLike, columns: Sequence[str]
) -> dict[str, Column]:
    """One message column per text, branching on the origin; 'N/A' when a required field is null."""
    messages = {}
    for item in texts:
        message = fill_template(item.default, columns)
        for source, wording in reversed(list(item.by_origin.items())):
            message = F.when(text(origin) == source, fill_template(wording, columns)).otherwise(message)
        if item.required is not None:
            message = F.when(as_column(item.required).isNull(), F.lit("N/A")).otherwise(message)
        messages[item.name] = message
    return messages
