"""SQL fragments the SQL twins share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from dunlake.functions import fixed_values as fixed


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def case_map(column: str, table: Mapping[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def debt_band(column: str) -> str:
    value = f"TRY_CAST({column} AS DOUBLE)"
    arms = " ".join(
        f"WHEN {value} <= {edge} THEN {quote(label)}" for edge, label in zip(fixed.DEBT_EDGES, fixed.DEBT_LABELS)
    )
    return f"CASE {arms} ELSE {quote(fixed.DEBT_ABOVE)} END"


def day_band(column: str, bands=fixed.DAY_BANDS, default: str = quote(fixed.OUT_OF_RANGE)) -> str:
    arms = " ".join(f"WHEN {column} BETWEEN {low} AND {high} THEN {quote(label)}" for low, high, label in bands)
    return f"CASE {arms} ELSE {default} END"


def long_of(column: str) -> str:
    return f"CASE WHEN regexp_full_match({column}, '[0-9]+') THEN TRY_CAST({column} AS BIGINT) END"


def valid_phone(column: str, low_m=3000000009, high_m=3599999999, low_f=6010000009, high_f=6089999999) -> str:
    value = f"TRY_CAST({column} AS BIGINT)"
    return f"({value} BETWEEN {low_m} AND {high_m} OR {value} BETWEEN {low_f} AND {high_f})"


def mobile(column: str) -> str:
    return f"TRY_CAST({column} AS BIGINT) BETWEEN 3000000009 AND 3599999999"


def assign_brand(origin, m5, m6, m7, refinanced, age, campaign=None) -> str:
    def three(mark, a, b, c):
        return (
            f"WHEN {mark} = 'Y' AND {origin} = 'BSCS' THEN '{a}' WHEN {mark} = 'Y' AND {origin} IN ('RR','SGA') "
            f"THEN '{b}' WHEN {mark} = 'Y' AND {origin} = 'ASCARD' THEN '{c}' "
        )

    inner = (
        "CASE " + three(m5, "Potencial", "Churn", "Provision") + three(m6, "Prepotencial", "Prechurn", "Preprovision")
        + f"WHEN {m7} = 'Y' THEN 'Castigo' WHEN {m5} = 'N' AND {m6} = 'N' AND {m7} = 'N' AND {refinanced} = 'Y' "
        f"THEN 'Potencial a Castigar' ELSE {age} END"
    )
    special = (
        f"WHEN ({inner}) = 'Prepotencial' AND {origin} = 'BSCS' AND {campaign} IN {in_list(fixed.SPECIAL_CAMPAIGNS)} "
        "THEN 'Prepotencial Especial' " if campaign else ""
    )
    return f"CASE WHEN ({inner}) IN ('120','150','180') THEN '120 - 180' {special}ELSE ({inner}) END"


def base_type(column: str) -> str:
    return (
        f"CASE WHEN {column} IN ('FLP 01','FLP 02','FLP 03') THEN 'CLIENTES ' || {column} "
        f"WHEN {column} = 'Clientes Corporativos' THEN 'CLIENTES CORPORATIVOS' ELSE 'CLIENTES INVENTARIO' END"
    )


def document_type(column: str) -> str:
    letters = f"regexp_replace({column}, '[^a-zA-Z]', '', 'g')"
    return (
        f"CASE WHEN {letters} IS NULL OR {letters} = '' THEN 'Sin tipologia' "
        f"ELSE {case_map(letters, fixed.DOCUMENT_TYPES, quote('Errado'))} END"
    )


def keyword_group(column: str, rules=fixed.CAMPAIGN_KEYWORDS) -> str:
    arms = []
    for group, words in reversed(rules):
        hits = " OR ".join(f"contains(lower({column}), {quote(w)})" for w in words)
        arms.append(f"WHEN {hits} THEN {quote(group)}")
    return f"CASE {' '.join(arms)} ELSE {column} END"


def unified_group(column: str, own: str = "") -> str:
    arms = [
        f"WHEN regexp_matches(lower({column}), {quote(pattern)}) THEN {quote(group)}"
        for pattern, group in fixed.UNIFIED_GROUPS
    ]
    if own:
        arms.insert(1, own)
    return f"CASE {' '.join(reversed(arms))} ELSE {column} END"


def discounted(amount: str, percent: str) -> str:
    price = f"TRY_CAST({amount} AS DOUBLE)"
    rate = f"TRY_CAST(replace({percent}, '%', '') AS DOUBLE)"
    return (
        f"CAST(trunc(CASE WHEN {percent} IS NULL OR {percent} IN ('0%','N/A') THEN {price} "
        f"ELSE {price} * (1 - {rate} / 100) END) AS BIGINT)"
    )


def plain_discount(percent: str) -> str:
    return f"CASE WHEN {percent} IS NULL OR {percent} IN ('0%','N/A','Sin Descuento') THEN '0' ELSE {percent} END"


def discount_class(percent: str) -> str:
    return f"CASE WHEN {percent} IS NULL OR {percent} IN ('0%','0','N/A') THEN 'Sin Descuento' ELSE 'Con Descuento' END"


def money_text(amount: str) -> str:
    return f"'$ ' || replace(format('{{:,}}', {amount}), ',', '.')"


def clean_name(column: str) -> str:
    """Name cleaning in the regular-expression dialect."""
    sql = f"upper({column})"
    for form in fixed.ENYE_FORMS:
        sql = f"replace({sql}, {quote(form)}, 'N')"
    for form, letter in fixed.MOJIBAKE_LETTERS:
        sql = f"replace({sql}, {quote(form)}, {quote(letter)})"
    for title in fixed.TITLE_PATTERNS:
        sql = f"regexp_replace({sql}, {quote(title)}, '', 'g')"
    sql = f"regexp_replace({sql}, '[.#/<>*]', '', 'g')"
    for title in fixed.COURTESY_TITLES:
        sql = f"replace({sql}, {quote(title)}, '')"
    sql = f"regexp_replace(replace({sql}, '?¿', ''), '[¡!_}}{{+-]', '', 'g')".replace("}}{{", "}{")
    for digit in "0123456789":
        sql = f"replace({sql}, '{digit} ', '')"
    sql = f"replace(regexp_replace({sql}, '[0-9]', '', 'g'), '  ', '')"
    sql = f"regexp_replace({sql}, '[^A-Z& ]', '', 'g')"
    for title in fixed.CLIPPED_TITLES:
        sql = f"replace({sql}, {quote(title)}, '')"
    return f"regexp_replace({sql}, '^(A\\s+| )+', '')"


def clean_name_literal(column: str) -> str:
    sql = f"upper({column})"
    for form in fixed.LITERAL_ENYE_FORMS:
        sql = f"replace({sql}, {quote(form)}, 'N')"
    for form, letter in fixed.MOJIBAKE_LETTERS:
        sql = f"replace({sql}, {quote(form)}, {quote(letter)})"
    for part in fixed.LITERAL_NAME_PARTS:
        sql = f"replace({sql}, {quote(part)}, '')"
    sql = f"regexp_replace({sql}, '[^A-Z& ]', '', 'g')"
    for title in fixed.CLIPPED_TITLES:
        sql = f"replace({sql}, {quote(title)}, '')"
    return f"regexp_replace({sql}, '^(A\\s+| )+', '')"


def short_name(column: str) -> str:
    words = f"str_split({column}, ' ')"
    return f"coalesce(list_filter({words}[1:4], lambda w: length(w) > 2)[1], {words}[2])"


def clean_email(column: str) -> str:
    pattern = "|".join(fixed.BLANKED_EMAIL_PATTERNS)
    low = f"lower({column})"
    blanked = (
        f"CASE WHEN contains({low}, '@') AND NOT regexp_matches({low}, {quote(pattern)}) THEN {low} ELSE '0' END"
    )
    return (
        f"regexp_replace(replace(replace({blanked}, 'sin segmento', '0'), '?¿', ''), '[#/<>*¡!{{}}+ -]', '', 'g')"
    ).replace("{{}}", "}{")


def payment_date(column: str) -> str:
    day = f"split_part(split_part({column}, ' ', 1), ':', 1)"

    def guarded(pattern: str, fmt: str) -> str:
        return f"CASE WHEN regexp_full_match({day}, {quote(pattern)}) THEN try_strptime({day}, {quote(fmt)}) END"

    parts = [
        guarded("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y"),
        guarded("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "%Y-%m-%d"),
        guarded("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%d-%m-%Y"),
        guarded("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "%d/%m/%y"),
        guarded("[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}", "%d-%m-%y"),
    ]
    return f"CAST(coalesce({', '.join(parts)}) AS DATE)"


def slash_date(column: str) -> str:
    return f"CAST(try_strptime(trim({column}), '%d/%m/%Y') AS DATE)"
