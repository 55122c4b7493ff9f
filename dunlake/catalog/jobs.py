"""Whole jobs B1-B30 over the stand-in views."""

from __future__ import annotations

from pyspark.sql import functions as F

from dunlake.catalog import sqltext as q
from dunlake.catalog.aggregations import _KEYWORDS, CALENDAR_SQL, MIX_SQL, VOLUME_FACT_SQL, _fact_sql, _volume_sql, shown_time, volume_specs
from dunlake.catalog.classifications import BOT_SQL, EMAIL_QUALITY
from dunlake.catalog.files import stage_csv
from dunlake.catalog.registry import query
from dunlake.catalog.relations import TOUCH_COUNT_SQL, channel_counts
from dunlake.catalog.scalars import AS_OF
from dunlake.functions import classes
from dunlake.functions import fixed_values as fixed
from dunlake.functions.messages import MessageText
from dunlake.operators.aggregates import multi_flags
from dunlake.plans import assignment, campaign, contactcenter, monthly, partners, payments, vendors
from dunlake.session import new_path
from dunlake.sources.text import text_schema

PHONES = ["celular1", "celular2", "celular3", "celular4", "fijo1", "fijo2", "min"]
BRANDS = ("0", "30", "potencial", "prechurn", "prepotencial")
ORIGINS = ("ASCARD", "BSCS", "RR")
SPEC = campaign.CampaignSpec(as_of=AS_OF, brands=BRANDS, origins=ORIGINS, low=20_000, high=2_000_000)

_RANKING = "CASE WHEN estado_ranking IS NULL OR estado_ranking = '' THEN 'NO APLICA FILTRO RANKING' ELSE estado_ranking END"
_TREATED = f"""
    previos AS (SELECT *, {_RANKING} AS rk FROM base),
    tratada AS (SELECT orden, identificacion, replace(cuenta, '-', '') AS cuenta, replace(cuenta2, '-', '') AS cuenta2, marca, origen, Mod_init_cta,
      TRY_CAST(Mod_init_cta AS DOUBLE) AS deuda, {q.plain_discount('descuento')} AS descuento, {q.clean_name('nombrecompleto')} AS nombrecompleto,
      referencia, fecha_vencimiento, fechagestion_contactodirecto, fecha_asignacion, customer_type_id, mejorperfil_mes, cant_servicios, plan, {', '.join(PHONES)}, email1, email2,
      date_diff('day', {q.slash_date('fecha_vencimiento')}, DATE '2001-06-15') AS dias,
      CASE WHEN ciudad = 'ASIGNACION_MANUAL_APPLE' THEN 'Apple Manual' ELSE marca END AS marca2,
      CASE WHEN tipo_pago IS NULL OR tipo_pago = '' THEN 'Sin Pago' ELSE tipo_pago END AS tipo_pago, {q.base_type('nombre_campana')} AS tipo_base,
      CASE WHEN rk = 'NO APLICA FILTRO RANKING' AND marca IN {q.in_list(fixed.SPECIAL_RANKING_BRANDS)} AND marca IN
        (SELECT marca FROM previos WHERE rk <> 'NO APLICA FILTRO RANKING') THEN 'RETIRAR' ELSE rk END AS estado_ranking FROM previos),
    elegida AS (SELECT *, {q.discounted('Mod_init_cta', 'descuento')} AS neto FROM tratada WHERE marca IN {q.in_list(BRANDS)} AND
      origen IN {q.in_list(ORIGINS)} AND tipo_pago IN ('Pago Parcial', 'Sin Pago'))
"""
_IN_RANGE = "deuda BETWEEN 20000 AND 2000000"


def _contacts_sql(slots, valid: str, where: str = _IN_RANGE) -> str:
    return (
        f"filas AS (SELECT DISTINCT ON (cuenta, dato) * FROM (SELECT *, UNNEST([{', '.join(slots)}]) AS dato FROM elegida "
        f"WHERE {where}) WHERE {valid})"
    )


@query(
    "b1_sms_base",
    f"""
    WITH {_TREATED}, {_contacts_sql(PHONES, q.mobile('dato'))}
    SELECT identificacion, cuenta || '-' AS cuenta, cuenta2 || '-' AS cuenta2, marca, marca2, origen, neto AS "Mod_init_cta",
      fecha_asignacion, customer_type_id, fecha_vencimiento, CAST(NULL AS VARCHAR) AS fechapromesa, mejorperfil_mes, cant_servicios, '08' AS "Hora_Envio",
      '08:00' AS "Hora_Real", 'Hola ' || coalesce({q.short_name('nombrecompleto')}, '') || ', crm ' || origen || '.' AS aviso,
      {q.money_text('neto')} AS "Form_Moneda", nombrecompleto, {q.debt_band('Mod_init_cta')} AS "Rango",
      CASE WHEN origen = 'RR' THEN cuenta ELSE referencia END AS referencia, dato AS "Dato_Contacto", descuento,
      CAST(trunc(deuda) AS BIGINT) AS "DEUDA_REAL", {q.case_map('origen', fixed.ORIGIN_LABELS['sms'], 'origen')} AS "PRODUCTO", tipo_pago,
      estado_ranking, tipo_base AS "Tipo Base", dias AS dias_transcurridos, {q.short_name('nombrecompleto')} AS "NOMBRE CORTO",
      CASE WHEN (CASE WHEN origen = 'RR' THEN cuenta ELSE referencia END) <> '' THEN 'Con referencia' ELSE 'SIN REFERENCIA' END AS "FILTRO_REFERENCIA",
      '15/06/2001' AS "Fecha_Hoy" FROM filas
    """,
)
def sms(t):
    return campaign.sms_base(t.base, SPEC, PHONES, [MessageText("aviso", "Hola (NOMBRE CORTO), crm (origen).")])


_REF = "CASE WHEN origen = 'RR' THEN cuenta ELSE referencia END"


@query(
    "b2_email_base",
    f"""
    WITH {_TREATED}, {_contacts_sql(['email1', 'email2'], "dato <> '' AND dato <> '0'")},
    limpias AS (SELECT *, CASE WHEN length(dato) - length(replace(dato, '@', '')) = 1 THEN 'EMAIL' ELSE 'DELIMITAR' END AS canal,
      {q.clean_email('dato')} AS correo, CASE WHEN {_REF} <> '' THEN 'Con referencia' ELSE 'SIN REFERENCIA' END AS filtro FROM filas)
    SELECT canal AS "Canal", correo AS "Dato_Contacto", descuento, marca AS "Edad_Mora", {q.case_map('origen', fixed.ORIGIN_LABELS['email'], 'origen')} AS "CRM",
      '$ ' || format('{{:,}}', neto) AS "Form_Moneda", nombrecompleto AS "Nombre_Completo", {_REF} AS "Referencia", cuenta2 AS "Cuenta", marca2,
      plan, identificacion, tipo_pago, filtro AS "FILTRO_REFERENCIA", {q.debt_band('Mod_init_cta')} AS "Rango", estado_ranking AS "RANKING STATUS",
      CASE WHEN length(nombrecompleto) < 4 OR canal = 'DELIMITAR' OR filtro = 'SIN REFERENCIA' THEN 'Ajustar antes de envio' ELSE
      'Limpio para envio' END AS "FILTRO GENERAL", tipo_base AS "Tipo Base" FROM limpias WHERE correo <> '0'
    """,
)
def email(t):
    return campaign.email_base(t.base, SPEC)


@query(
    "b3_ivr_base",
    f"""
    WITH {_TREATED}, {_contacts_sql(PHONES, q.valid_phone('dato'), _IN_RANGE + " AND tipo_pago <> 'Pago Parcial'")}
    SELECT dato AS "TELEFONO 1", identificacion AS "DOCUMENTO", cuenta AS "IDENTI", neto AS "MONTO_INICIAL", origen AS "CRM_ORIGEN",
      marca AS "MARCA_ASIGNADA", dias AS "DIAS DE MORA", CASE WHEN TRY_CAST(dato AS BIGINT) < 6000000000 THEN 'Celular' ELSE 'Fijo' END AS "Tipo de Linea",
      {q.short_name('nombrecompleto')} AS "NOMBRE CORTO", descuento AS "DESCUENTO", tipo_pago, tipo_base AS "TIPO BASE" FROM filas
    """,
)
def ivr(t):
    return campaign.ivr_base(t.base, SPEC, phones=PHONES)


@query(
    "b3_ivr_base_mailed",
    f"""
    WITH {_TREATED}, {_contacts_sql(PHONES, q.valid_phone('dato'), _IN_RANGE + " AND tipo_pago <> 'Pago Parcial'")}
    SELECT identificacion, {q.short_name('nombrecompleto')} AS nombre, dato AS telefono, cuenta, neto AS saldo, origen AS "CRM", marca AS "MARCA",
      dias AS "DIAS DE MORA", CASE WHEN TRY_CAST(dato AS BIGINT) < 6000000000 THEN 'Celular' ELSE 'Fijo' END AS "Tipo de Linea",
      estado_ranking AS "RANKING STATUS", tipo_base AS "TIPO BASE" FROM filas
    """,
)
def ivr_mailed(t):
    return campaign.ivr_base(t.base, SPEC, "mailed", PHONES)


_NET_RANGE = "neto BETWEEN 20000 AND 2000000"
_BOT_REF = f"replace({_REF}, '-', '')"
_NAMES = "str_split(nombrecompleto, ' ')"


def _bot_sql(valid: str, phone: str, brand: str, box: str) -> str:
    return f"""
    WITH {_TREATED}, {_contacts_sql(PHONES, valid, _NET_RANGE)}
    SELECT marca AS "NOMBRE CAMPANA", identificacion AS "IDENTIFICACION",
      array_to_string({_NAMES}[1:length({_NAMES}) // 2 + length({_NAMES}) % 2], ' ') AS "NOMBRE COMPLETO",
      array_to_string({_NAMES}[length({_NAMES}) // 2 + 1:length({_NAMES})], ' ') AS "APELLIDO COMPLETO", {phone} AS "CELULAR", neto AS "MONTO",
      {brand} AS "MARCA", CASE WHEN origen = 'ASCARD' THEN 'bloqueo' ELSE 'suspension' END AS "ESTADO", dias AS "DIAS MORA", {box} AS "CAJA", cuenta,
      cuenta2 AS "CUENTA_NEXT", descuento AS "DESCUENTO", CASE WHEN {_BOT_REF} <> '' THEN {_BOT_REF} ELSE 'SIN REFERENCIA' END AS "REFERENCIA",
      '2001-06-15' AS "FECHA PLAZO" FROM filas
    """


@query(
    "b4_bot_base",
    _bot_sql(q.valid_phone("dato"), "dato", q.case_map("origen", fixed.ORIGIN_LABELS["bot"], "origen"),
             q.case_map("origen", fixed.BOX_CODES, "'Error'")),
)
def bot(t):
    return campaign.bot_base(t.base, SPEC, "full", PHONES)


@query("b4_bot_base_personal", _bot_sql(q.mobile("dato"), "'57' || dato", "tipo_base", "'Mensaje Personalizado'"))
def bot_personal(t):
    return campaign.bot_base(t.base, SPEC, "personal", PHONES)


@query(
    "b4_bot_base_short",
    f"""
    WITH {_TREATED}, {_contacts_sql(PHONES, q.valid_phone('dato'), _NET_RANGE)}
    SELECT '57' || dato AS phone, {q.short_name('nombrecompleto')} AS name, neto AS debtamount, dias AS debtdays, 'pesos' AS currency,
      identificacion AS document, cuenta AS "CUENTA", marca AS "Edad de Mora", origen AS origin, cuenta2 AS "CUENTA_NEXT", fecha_vencimiento AS "FLP" FROM filas
    """,
)
def bot_short(t):
    return campaign.bot_base(t.base, SPEC, "short", PHONES)


_KEPT = ["cuenta", "cuenta2", "origen", "marca", "marca2", "descuento", "tipo_pago", "fecha_vencimiento"]


def _phone_cells(n: int) -> str:
    return ", ".join(f"coalesce(max(CASE WHEN r = {i} THEN dato END), '') AS phone{i}" for i in range(1, n + 1))


@query(
    "b5_task_list",
    f"""
    WITH {_TREATED}, telefonos AS (SELECT *, UNNEST([{', '.join(PHONES)}]) AS dato FROM elegida WHERE {_IN_RANGE} AND
      (fechagestion_contactodirecto IS NULL OR fechagestion_contactodirecto <> '2001-06-15') AND
      CASE WHEN origen = 'RR' THEN cuenta ELSE referencia END <> ''),
    uno AS (SELECT * FROM telefonos WHERE {q.valid_phone('dato')} QUALIFY row_number() OVER (PARTITION BY dato ORDER BY identificacion, cuenta) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY identificacion ORDER BY cuenta, dato) AS r FROM uno)
    SELECT identificacion, {', '.join(f'min_by({c}, r) AS {c}' for c in _KEPT)}, CAST(trunc(min_by(deuda, r)) AS BIGINT) AS "Mod_init_cta",
      min_by(dias, r) AS dias_transcurridos, {_phone_cells(9)} FROM r WHERE r <= 9 GROUP BY 1
    """,
)
def task_list(t):
    return campaign.task_base(t.base, SPEC, PHONES)


_COUNT_MOBILE = "CAST(count(*) FILTER (r <= 13 AND TRY_CAST(dato AS BIGINT) BETWEEN 3000000009 AND 3599999999) AS INT)"
_COUNT_FIXED = "CAST(count(*) FILTER (r <= 13 AND TRY_CAST(dato AS BIGINT) BETWEEN 6000000009 AND 6599999999) AS INT)"


@query(
    "b6_reorder",
    f"""
    WITH {_TREATED}, f AS (SELECT DISTINCT ON (cuenta, dato) * FROM (SELECT *, UNNEST([{', '.join(PHONES)}]) AS dato FROM tratada WHERE marca <> 'castigo')
      WHERE {q.valid_phone('dato', low_f=6010000000)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY cuenta, identificacion ORDER BY dato) AS r FROM f),
    w AS (SELECT cuenta, identificacion, {', '.join(f'min_by({c}, r) AS {c}' for c in ('cuenta2', 'marca', 'marca2', 'origen', 'nombrecompleto', 'referencia', 'descuento'))},
      min_by(tipo_base, r) AS "Tipo Base", min_by(Mod_init_cta, r) AS bruto, {_phone_cells(13)}, {_COUNT_MOBILE} AS m, {_COUNT_FIXED} AS x FROM r GROUP BY 1, 2)
    SELECT * EXCLUDE (bruto, m, x), {q.discounted('bruto', 'descuento')} AS "Mod_init_cta", m AS "No.Movil", x AS "No.Fijo",
      CASE WHEN m > 0 THEN 'SI TIENE' ELSE 'NO TIENE' END AS "MOVIL", CASE WHEN x > 0 THEN 'SI TIENE' ELSE 'NO TIENE' END AS "FIJO",
      {' || '.join(f"CASE WHEN phone{i} = '' THEN '3' WHEN TRY_CAST(phone{i} AS BIGINT) <= 3599999999 THEN '1' ELSE '2' END" for i in range(1, 14))}
      AS orden_contacto FROM w
    """,
)
def reorder(t):
    return campaign.reorder_base(t.base, PHONES)


def _partner_sql(
    source: str, account: str, document: str, name: str, price: str, entry: str | None, where: str, slots: str, valid: str | None = None
) -> str:
    days = f"date_diff('day', {q.payment_date(entry)}, DATE '2001-06-15')" if entry else "CAST(NULL AS BIGINT)"
    return f"""
    SELECT DISTINCT ON (cuenta, "Dato_Contacto") * FROM (
    SELECT {account} AS cuenta, {document} AS identificacion, dato AS "Dato_Contacto", {q.debt_band(price)} AS "Rango",
      CAST(trunc(TRY_CAST({price} AS DOUBLE)) AS BIGINT) AS precio, {q.money_text(f'CAST(trunc(TRY_CAST({price} AS DOUBLE)) AS BIGINT)')} AS "Form_Moneda",
      {q.short_name(q.clean_name(name))} AS "NOMBRE CORTO", {days} AS dias_transcurridos
    FROM (SELECT *, {slots} AS dato FROM {source} {where}) WHERE {valid or q.valid_phone('dato')}) ORDER BY cuenta, "Dato_Contacto", identificacion
    """


_LIST_ITEMS = r"UNNEST(str_split(regexp_replace(lista_telefonos, '[\[\]{}\"\s]', '', 'g'), '|'))".replace('\\"', '"')
_GOOD = " AND ".join(f"{c} NOT IN {q.in_list(fixed.BAD_PROFILES)}" for c in ("mejorperfil", "ultimoperfil"))


@query(
    "b7_partner_slots",
    _partner_sql("base", "cuenta2", "identificacion", "nombrecompleto", "Mod_init_cta", "fecha_corta", "",
                 f"UNNEST([{', '.join(PHONES)}])"),
)
def partner_slots(t):
    spec = partners.PartnerSpec("cuenta2", "identificacion", "nombrecompleto", "Mod_init_cta", "fecha_corta", PHONES)
    return partners.partner_base(t.base, spec, AS_OF)


@query(
    "b7_partner_list_cell",
    _partner_sql("base", "cuenta2", "identificacion", "nombrecompleto", "Mod_init_cta", None,
                 f"WHERE {_GOOD} AND nombre_campana IS NULL AND lista_telefonos IS NOT NULL", _LIST_ITEMS),
)
def partner_list(t):
    spec = partners.PartnerSpec(
        "cuenta2", "identificacion", "nombrecompleto", "Mod_init_cta", None, (), "lista_telefonos",
        profiles=("mejorperfil", "ultimoperfil"), unpaid_column="nombre_campana",
    )
    return partners.partner_base(t.base, spec, AS_OF)


@query(
    "b7_partner_emails",
    _partner_sql("base", "cuenta2", "identificacion", "nombrecompleto", "Mod_init_cta", "fecha_corta", "", "UNNEST([email1, email2])", "contains(dato, '@')"),
)
def partner_emails(t):
    spec = partners.PartnerSpec("cuenta2", "identificacion", "nombrecompleto", "Mod_init_cta", "fecha_corta", PHONES, emails=("email1", "email2"))
    return partners.partner_base(t.base, spec, AS_OF, emails=True)


# Columns of the stand-in base under the names of each partner file.
_PARTNER_SLOTS = ("celular1", "celular2", "fijo1")
_PARTNER_FILES = {
    "slots_with_dialed": ("id_usuario", "identificacion", "titular", "por_pagar_total", "fecha_ingreso"),
    "slots_mobile": ("cuenta", "identificacion", "nombrecompleto", "saldo_total", "fecha_ingreso"),
    "slots_network": ("cuenta", "identificacion", "nombrecompleto", "valor_a_pagar", "fecha_ingreso"),
    "list_cell_comma": ("cuenta", "identificacion", "nombrecompleto", "saldo_total", "sin_fecha"),
    "list_cell_pipe": ("account", "identifitation", "nombrecompleto", "pago_minimo", "fechagestion"),
    "repeated_headers": ("cuenta", "identificacion", "nombrecompleto", "valor_a_pagar", "fecha_ingreso"),
}
_PARTNER_ITEMS = {
    "list_cell_comma": ("[celular1, celular2]", ""),
    "list_cell_pipe": ("[celular1, celular2, fijo1]", f"WHERE {_GOOD} AND nombre_campana IS NULL"),
    "repeated_headers": (
        "[celular1, celular2, fijo1]",
        f"WHERE {_GOOD} AND " + " AND ".join(f"{c} NOT IN {q.in_list(fixed.BAD_PROFILES)}" for c in ("mejorperfil_mes", "perfil_historico")),
    ),
}


def _partner_rows(name: str) -> str:
    items, where = _PARTNER_ITEMS.get(name, (f"[{', '.join(_PARTNER_SLOTS)}]", ""))
    days = "0" if name == "list_cell_comma" else f"coalesce(date_diff('day', {q.payment_date('fecha_corta')}, DATE '2001-06-15'), 0)"
    return (
        f"SELECT '{name}' AS socio, {q.debt_band('Mod_init_cta')} AS \"Rango\", CAST(count(*) AS BIGINT) AS contactos, "
        f"CAST(sum(CAST(trunc(TRY_CAST(Mod_init_cta AS DOUBLE)) AS BIGINT)) AS BIGINT) AS precio, CAST(sum({days}) AS BIGINT) AS dias "
        f"FROM (SELECT DISTINCT ON (cuenta2, dato) * FROM (SELECT *, UNNEST({items}) AS dato FROM base {where}) WHERE {q.valid_phone('dato')}) GROUP BY 2"
    )


def partner_file(t, name: str):
    account, document, title, price, day = _PARTNER_FILES[name]
    columns = [f"cuenta2 AS {account}", f"identificacion AS {document}", f"nombrecompleto AS {title}", f"Mod_init_cta AS {price}", f"fecha_corta AS {day}"]
    if name == "list_cell_comma":
        columns.append("concat_ws(',', concat('[', coalesce(celular1, '')), concat(coalesce(celular2, ''), ']')) AS telefonos")
    elif name == "list_cell_pipe":
        columns += ["concat_ws('|', celular1, celular2) AS telefonos", "fijo1 AS telefono", "mejorperfil", "ultimoperfil", "nombre_campana AS valor_pago"]
    elif name == "repeated_headers":
        columns += ["celular1 AS celular", "celular2 AS celular_1", "fijo1 AS numeromarcado", "mejorperfil", "ultimoperfil",
                    "mejorperfil_mes", "perfil_historico AS ultimoperfil_mes"]
    else:
        columns += list(_PARTNER_SLOTS)
    return t.base.selectExpr(*columns)


@query("b7_partners", " UNION ALL ".join(_partner_rows(name) for name in _PARTNER_FILES))
def all_partners(t):
    """The six partner files through the one pipeline, summed per band."""
    result = None
    for name, spec in partners.PARTNERS.items():
        rows = partners.partner_base(partner_file(t, name), spec, AS_OF)
        part = rows.groupBy(F.lit(name).alias("socio"), "Rango").agg(
            F.count("*").alias("contactos"),
            F.sum("precio").alias("precio"),
            F.sum(F.coalesce("dias_transcurridos", F.lit(0))).alias("dias"),
        )
        result = part if result is None else result.unionByName(part)
    return result


ASSIGNED = (
    "SELECT b.*, p.fecha AS dia_asignado, p.dia AS numero FROM base b JOIN (SELECT CAST(split_part(clave, '-', 1) AS BIGINT) AS usuario, "
    "fecha, dia FROM presencia) p ON p.usuario = b.orden"
)


def assigned_rows(t):
    """One row per account and day: the events of a user are the days of the account with that number."""
    days = t.presencia.select(F.split_part("clave", F.lit("-"), F.lit(1)).cast("bigint").alias("orden"), "fecha")
    rows = t.base.join(days, "orden")
    return rows.select(
        F.col("documento"), F.col("cuenta"), F.col("origen"), "marca5", "marca6", "marca7",
        F.col("Mod_init_cta").alias("deuda"), F.col("nombre_campana").alias("campana"), "edad", "ciudad",
        F.col("nombrecompleto").alias("nombre"), F.col("identificacion").alias("corrida"),
        F.col("fecha_vencimiento").alias("vencimiento"), "referencia", F.col("celular1").alias("linea"),
        F.col("customer_type_id").alias("tipo_cliente"), "refinanciada", F.col("fecha").alias("dia"),
    )


def _discount_rows(t):
    return t.base.select(
        F.translate("cuenta", ".-", "").alias("CUENTA"), F.translate("descuento", "%", "").alias("PORCENTAJE")
    )


_BRAND = q.assign_brand("origen", "marca5", "marca6", "marca7", "refinanciada", "edad", "nombre_campana")


@query(
    "b8_structured_assignment",
    f"""
    WITH asignada AS ({ASSIGNED}), p AS (SELECT DISTINCT cuenta AS clave, numero AS dia FROM asignada),
    g AS (SELECT clave, min(dia) AS primero, max(dia) AS ultimo FROM p GROUP BY 1),
    d AS (SELECT g.*, UNNEST(range(1, 32)) AS dia FROM g),
    e AS (SELECT d.*, CASE WHEN p.dia IS NOT NULL THEN 'Asignada' WHEN d.dia > primero AND d.dia < ultimo THEN 'Sin reasignar'
      WHEN d.dia = ultimo + 1 AND d.dia <= (SELECT max(dia) FROM p) THEN 'Retirada' ELSE '' END AS estado FROM d LEFT JOIN p ON p.clave = d.clave AND p.dia = d.dia),
    s AS (SELECT clave, CAST(count(*) FILTER (estado = 'Asignada') AS INT) AS a, CAST(count(*) FILTER (estado IN ('Retirada', 'Sin reasignar')) AS INT) AS r,
      min(dia) FILTER (estado = 'Asignada') AS entra, max(dia) FILTER (estado = 'Retirada') AS sale, array_to_string(list(estado ORDER BY dia), ',') AS dias FROM e GROUP BY 1),
    dcto AS (SELECT replace(replace(cuenta, '-', ''), '.', '') || '-' AS llave, replace(descuento, '%', '') AS pct FROM base),
    u AS (SELECT *, regexp_replace(documento, '[^0-9]', '', 'g') AS doc, {_BRAND} AS marca_final,
      replace(replace(cuenta, '-', ''), '.', '') || '-' AS cuenta_next FROM base WHERE cuenta IN (SELECT clave FROM s)),
    v AS (SELECT u.*, s.*, coalesce(pct, '0') AS pct, CASE WHEN coalesce(TRY_CAST(coalesce(pct, '0') AS DOUBLE), 0) = 0 THEN 0.0 ELSE
      TRY_CAST(Mod_init_cta AS DOUBLE) * (1 - TRY_CAST(pct AS DOUBLE) / 100) END AS rebajado,
      CASE WHEN origen = 'RR' THEN cuenta WHEN referencia IS NOT NULL THEN referencia ELSE '0' END AS ref
      FROM u JOIN s ON s.clave = u.cuenta LEFT JOIN dcto ON llave = cuenta_next),
    m AS (SELECT doc AS md, count(doc) AS c, count(DISTINCT origen) AS o, count(DISTINCT marca_final) AS b FROM v GROUP BY 1)
    SELECT doc AS "DOCUMENTO", {q.document_type('documento')} AS "TIPO DE DOCUMENTO", cuenta || '-' AS "CUENTA", cuenta_next AS "CUENTA_NEXT",
      marca_final AS "MARCA", origen AS "CRM", CASE WHEN customer_type_id IN ('81','84','87') THEN 'Personas' ELSE 'Negocios' END AS "SEGMENTO",
      TRY_CAST(Mod_init_cta AS DOUBLE) AS "VALOR DEUDA", {q.debt_band('Mod_init_cta')} AS "RANGO DEUDA", ref AS "REFERENCIA",
      {q.clean_name('nombrecompleto')} AS "NOMBRE", a AS "DIAS ASIGNADA", r AS "DIAS RETIRADA", a + r AS "RANGO DE DIAS", {q.day_band('(a + r)')} AS
      "GRUPO RANGO DE DIAS", entra || '/1/2024' AS "FECHA INGRESO", coalesce(sale || '/1/2024', '-') AS "FECHA RETIRO",
      CASE WHEN sale IS NULL THEN 'En gestion' ELSE 'Recuperada' END AS "ESTADO CUENTA", dias, pct AS "PORCENTAJE", round(rebajado, 4) AS "VALOR DESCUENTO",
      CASE WHEN rebajado = 0 THEN '0 No Aplica' ELSE {q.debt_band('rebajado')} END AS "RANGO CON DESCUENTO",
      CASE WHEN c > 1 THEN 'Aplica' ELSE 'No aplica' END AS "MULTICUENTA", CASE WHEN o > 1 THEN 'Aplica' ELSE 'No aplica' END AS "MULTIPRODUCTO",
      CASE WHEN b > 1 THEN 'Aplica' ELSE 'No aplica' END AS "MULTIMORA",
      CASE WHEN length(ref) > 3 THEN 'Con referencia' ELSE 'Sin Referencia' END AS "FILTRO REFERENCIA"
    FROM v JOIN m ON md IS NOT DISTINCT FROM doc
    """,
)
def structured(t):
    result = assignment.structured_assignment(assigned_rows(t), _discount_rows(t), "1/2024")
    return result.withColumns(
        {"dias": F.array_join("dias", ","), "VALOR DESCUENTO": F.round("VALOR DESCUENTO", 4)}
    )


def contact_list(t):
    slots = F.array("celular1", "celular2", "celular3", "fijo1", "email1", "email2")
    return t.base.select("identificacion", F.col("cuenta2").alias("cuenta"), F.explode(slots).alias("dato"))


def _slots_sql(n: int, prefix: str, valid: str) -> str:
    cells = ", ".join(f"coalesce(max(CASE WHEN r = {i} THEN dato END), '') AS {prefix}{i}" for i in range(1, n + 1))
    return (
        f"SELECT cuenta, identificacion, count(*) AS n, {cells}, count(*) FILTER (TRY_CAST(dato AS BIGINT) BETWEEN 3000000009 AND 3599999999) AS m, "
        f"count(*) FILTER (TRY_CAST(dato AS BIGINT) BETWEEN 6000000009 AND 6599999999) AS x FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY cuenta, identificacion ORDER BY dato) AS r FROM (SELECT DISTINCT cuenta, identificacion, dato FROM lista WHERE {valid})) "
        f"WHERE r <= {n} GROUP BY 1, 2"
    )


def _shown(name: str) -> str:
    return f"CASE WHEN coalesce({name}, 0) = 0 THEN '' ELSE CAST({name} AS VARCHAR) END"


@query(
    "b9_demographics",
    f"""
    WITH lista AS (SELECT identificacion, replace(cuenta2, '-', '') || '-' AS cuenta, UNNEST([celular1, celular2, celular3, fijo1, email1, email2]) AS dato FROM base),
    f AS ({_slots_sql(20, 'phone', q.valid_phone('dato', low_f=6010000000))}), e AS ({_slots_sql(5, 'email', "contains(dato, '@')")}),
    j AS (SELECT coalesce(f.cuenta, e.cuenta) AS cuenta, coalesce(f.identificacion, e.identificacion) AS identificacion, f.m, f.x, e.n AS c,
      {', '.join(f'phone{i}' for i in range(1, 21))}, {', '.join(f'email{i}' for i in range(1, 6))} FROM f FULL JOIN e ON f.cuenta = e.cuenta)
    SELECT * EXCLUDE (m, x, c), {_shown('m')} AS "NumMovil", {_shown('x')} AS "NumFijo", {_shown('c')} AS "NumEmail",
      CASE WHEN m > 0 AND x > 0 AND c > 0 THEN 'Celular Fijo Email' WHEN m > 0 AND x > 0 THEN 'Celular Fijo' WHEN m > 0 AND c > 0 THEN 'Celular Email'
      WHEN m > 0 THEN 'Celular' WHEN x > 0 AND c > 0 THEN 'Fijo Email' WHEN x > 0 THEN 'Fijo' WHEN c > 0 THEN 'Email' ELSE 'No posee Demograficos' END
      AS "Filtro Demografico" FROM j
    """,
)
def demographic_slots(t):
    return monthly.demographics(contact_list(t))


@query(
    "b10_monthly_touches",
    f"""
    WITH toques AS ({TOUCH_COUNT_SQL}), anchas AS (SELECT cuenta_sin_punto, cuenta_real, marca, {', '.join(
        f"CAST(coalesce(sum(CASE WHEN canal = '{c}' THEN cantidad END), 0) AS BIGINT) AS toques_{c}" for c in ('click', 'error', 'view', 'purchase'))}
      FROM toques WHERE canal IN ('click', 'error', 'view', 'purchase') GROUP BY 1, 2, 3),
    una AS (SELECT * FROM anchas QUALIFY row_number() OVER (PARTITION BY cuenta_sin_punto ORDER BY cuenta_real, marca) = 1)
    SELECT * REPLACE (lower(marca) AS marca), '01' AS "MES DE ASIGNACION", '2024' AS "PERIODO DE ASIGNACION" FROM una
    WHERE lower(marca) IN {q.in_list(fixed.TOUCH_BRANDS)}
    """,
)
def month_touches(t):
    return monthly.monthly_touches(channel_counts(t), "01", "2024")


_WIDE_RULES = "SELECT 1 AS prioridad, 'BOGOTA' AS pueblo, 'CUNDINAMARCA' AS departamento UNION ALL SELECT 2, 'CALI', 'VALLE DEL CAUCA' UNION ALL SELECT 3, 'QUILICHAO', 'CAUCA' UNION ALL SELECT 4, 'MEDELLIN', 'ANTIOQUIA'"
_MORA = f"date_diff('day', {q.slash_date('fecha_vencimiento')}, {q.slash_date('fecha_asignacion')})"


@query(
    "b11_wide_dataset",
    f"""
    WITH g AS ({MIX_SQL}), demo AS (SELECT cuenta2, CASE WHEN {q.mobile('celular1')} THEN 1 ELSE 0 END AS m, CASE WHEN TRY_CAST(fijo1 AS BIGINT)
      BETWEEN 6000000009 AND 6599999999 THEN 1 ELSE 0 END AS x, CASE WHEN contains(coalesce(email1, ''), '@') THEN 1 ELSE 0 END AS c FROM base),
    toques AS (SELECT cuenta, CAST(count(*) FILTER (canal = 'click') AS BIGINT) AS sms, CAST(count(*) FILTER (canal = 'view') AS BIGINT) AS mail,
      CAST(count(*) FILTER (canal = 'signup') AS BIGINT) AS bot, CAST(count(*) FILTER (canal = 'error') AS BIGINT) AS ivr FROM contactos GROUP BY 1),
    multi AS (SELECT identificacion AS doc, count(*) > 1 AS varias, count(DISTINCT origen) > 1 AS origenes, count(DISTINCT marca) > 1 AS marcas FROM base GROUP BY 1),
    reporte AS (SELECT o_orderkey AS k, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS pagos FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    w AS (SELECT b.*, m, x, c, pagos, toques.* EXCLUDE (cuenta), varias, origenes, marcas, contacto_directo, contacto_indirecto, no_contacto, mezcla, orden % 40 AS asignada, orden % 33 AS retirada, {_MORA} AS mora,
      CASE WHEN ciudad IS NULL OR trim(ciudad) = '' THEN 'VACIO' WHEN contains(ciudad, 'BOGOTA') THEN 'CUNDINAMARCA' WHEN contains(upper(split_part(ciudad, '/', 1)), 'CALI')
      THEN 'VALLE DEL CAUCA' WHEN contains(ciudad, 'QUILICHAO') THEN 'CAUCA' WHEN contains(ciudad, 'MEDELLIN') THEN 'ANTIOQUIA' WHEN ciudad = 'CALDAS' THEN 'CALDAS'
      WHEN ciudad = 'HUILA/NEIVA' THEN 'HUILA' ELSE 'NO IDENTIFICADO' END AS depto
      FROM base b LEFT JOIN demo d ON d.cuenta2 = b.cuenta2 LEFT JOIN reporte ON k = b.orden LEFT JOIN g ON g.cuenta || '-' = b.cuenta2
      LEFT JOIN toques ON toques.cuenta || '-' = b.cuenta2 JOIN multi ON doc = b.identificacion)
    SELECT CASE WHEN varias THEN 'Aplica' ELSE 'No aplica' END AS "DS_VAR_multicuenta", CASE WHEN origenes THEN 'Aplica' ELSE 'No aplica' END AS "DS_VAR_multiproducto",
      CASE WHEN marcas THEN 'Aplica' ELSE 'No aplica' END AS "DS_VAR_multimora", {q.document_type('documento')} AS "DS_VAR_tipo_de_documento", customer_type_id AS "DS_VAR_customer_type",
      m AS "DS_VAR_cantidad_moviles", x AS "DS_VAR_cantidad_fijos", c AS "DS_VAR_cantidad_emails", asignada AS "DS_VAR_dias_asignada", retirada AS "DS_VAR_dias_retirada",
      CASE WHEN origen = 'RR' THEN 'APLICA' END AS "AD_exclusion_cuenta", estado_ranking AS "AD_estado_ranking", cant_servicios AS "AD_servicios_ranking",
      pagos AS "AD_recuento_pagos", orden % 10 AS "AD_recuento_no_gestion", sms AS "AD_toques_por_sms", mail AS "AD_toques_por_email", bot AS "AD_toques_por_bot",
      ivr AS "AD_toques_por_ivr", celular1 AS "FLT_phone1", celular2 AS "FLT_phone2", fijo1 AS "FLT_phone3", email1 AS "FLT_email1", email2 AS "FLT_email2",
      cuenta2 AS "BG_cuenta_next", identificacion AS "BG_documento", marca AS "BG_marca", origen AS "BG_crm", Mod_init_cta AS "BG_saldo",
      fecha_asignacion AS "BG_fecha_ingreso", fecha_vencimiento AS "BG_fecha_vencimiento", {q.debt_band('Mod_init_cta')} AS "DS_VAR_rango_deuda", depto AS "DS_VAR_departamento",
      {q.day_band('asignada')} AS "DS_VAR_rango_de_dias_asignada", {q.day_band('retirada')} AS "DS_VAR_rango_de_dias_retirada",
      {q.day_band('mora', (fixed.NOT_YET_DUE_BAND, *fixed.DAY_BANDS, fixed.LONG_OVERDUE_BAND), "CASE WHEN mora IS NULL THEN 'Nulo' ELSE 'Fuera de rango' END")} AS "DS_VAR_rango_de_dias_mora",
      mezcla AS "DS_VAR_filtro_reporte_gestion", CASE WHEN m > 0 AND x > 0 AND c > 0 THEN 'Celular Fijo Email' WHEN m > 0 AND x > 0 THEN 'Celular Fijo'
      WHEN m > 0 AND c > 0 THEN 'Celular Email' WHEN m > 0 THEN 'Celular' WHEN x > 0 AND c > 0 THEN 'Fijo Email' WHEN x > 0 THEN 'Fijo' WHEN c > 0 THEN 'Email'
      ELSE 'No posee Demograficos' END AS "DS_VAR_filtro_demograficos", m + x + c AS "DS_VAR_cantidad_demograficos", mora AS "DS_VAR_dias_mora",
      contacto_directo AS "DS_VAR_contacto_directo", contacto_indirecto AS "DS_VAR_contacto_indirecto", no_contacto AS "DS_VAR_no_contacto",
      CASE WHEN TRY_CAST(replace(descuento, '%', '') AS DOUBLE) = 0 THEN 'No Aplica' ELSE 'Aplica' END AS "AD_filtro_descuento",
      CASE WHEN pagos >= 1 THEN 'Aplica' ELSE '' END AS "AD_filtro_pagos_sin_aplicar", CASE WHEN orden % 10 <> 0 THEN 'Aplica' ELSE '' END AS "AD_filtro_no_gestion",
      CASE WHEN identificacion IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0) THEN 'APLICA' END AS "AD_exclusion_documento"
    FROM w WHERE fecha_asignacion IS NOT NULL
    """,
)
def wide(t):
    base = t.base.select(
        F.translate("cuenta2", "-", "").alias("CUENTA NEXT"), F.col("identificacion").alias("DOCUMENTO"), F.col("marca").alias("MARCA"),
        F.col("origen").alias("CRM"), F.col("Mod_init_cta").alias("SALDO"), F.col("fecha_asignacion").alias("FECHA INGRESO"),
        F.col("fecha_vencimiento").alias("FECHA VENCIMIENTO"), F.col("ciudad").alias("CIUDAD"), F.col("descuento").alias("PORCENTAJE"),
        (F.col("orden") % 40).alias("DIAS ASIGNADA"), (F.col("orden") % 33).alias("DIAS RETIRADA"),
    )
    mobile = F.col("celular1").try_cast("bigint").between(*fixed.MOBILE_RANGE)
    fixed_line = F.col("fijo1").try_cast("bigint").between(*fixed.COUNTED_LANDLINE_RANGE)
    contacts = t.base.select(
        F.col("orden").cast("string").alias("CUENTA NEXT"),
        F.when(mobile, 1).otherwise(0).alias("NumMovil"),
        F.when(fixed_line, 1).otherwise(0).alias("NumFijo"),
        F.when(F.contains("email1", F.lit("@")), 1).otherwise(0).alias("NumEmail"),
        F.col("celular1").alias("phone1"), F.col("celular2").alias("phone2"), F.col("fijo1").alias("phone3"), "email1", "email2",
    )
    channels = {"SMS": "click", "EMAIL": "view", "BOT": "signup", "IVR": "error"}
    touches = t.contactos.groupBy(F.col("cuenta").alias("CUENTA NEXT")).agg(
        *[F.count_if(F.col("canal") == channel).alias(f"Toques por {name}") for name, channel in channels.items()]
    )
    number = F.col("orden").cast("string").alias("CUENTA NEXT")
    flags = multi_flags(t.base.select("orden", "identificacion", "origen", "marca", "documento", "customer_type_id"), "identificacion", "origen", "marca")
    assigned = flags.select(
        number, "MULTICUENTA", "MULTIPRODUCTO", "MULTIMORA", classes.document_type("documento").alias("TIPO DE DOCUMENTO"), F.col("customer_type_id").alias("CUSTOMER TYPE")
    )
    queues = t.base.select(number, F.col("fecha_iso").alias("FECHA PAGO DE COLA"))
    ranked = t.base.select(number, F.col("estado_ranking").alias("ESTADO RANKING"), F.col("cant_servicios").alias("SERVICIOS RANKING"))
    excluded = t.base.filter(F.col("origen") == "RR").select(number, F.lit("APLICA").alias("EXCLUSION CUENTA"))
    paid = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("RECUENTO PAGOS"))
    paid = paid.select(F.concat(F.col("l_orderkey"), F.lit(".0")).alias("CUENTA NEXT"), "RECUENTO PAGOS")
    unmanaged = t.base.select(
        F.col("orden").cast("string").alias("CUENTA NEXT"), (F.col("orden") % 10).alias("RECUENTO NO GESTION")
    )
    report = t.contactos.select(F.col("cuenta").alias("CUENTA NEXT"), "perfil")
    documents = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("DOCUMENTO"))
    rules = t.spark.sql(_WIDE_RULES)
    satellites = {
        "contactos": (contacts, ["NumMovil", "NumFijo", "NumEmail"]),
        "toques": (touches, ["Toques por SMS"]),
        "asignacion": (assigned, ["MULTICUENTA"]),
        "colas": (queues, ["FECHA PAGO DE COLA"]),
        "ranking": (ranked, ["ESTADO RANKING"]),
        "cuentas_excluidas": (excluded, ["EXCLUSION CUENTA"]),
        "pagos": (paid, ["RECUENTO PAGOS"]),
        "no_gestion": (unmanaged, ["RECUENTO NO GESTION"]),
    }
    return monthly.wide_dataset(base, satellites, documents, report, rules)


_ACCOUNT = "CASE WHEN cuenta_real IS NULL OR trim(cuenta_real) = '' THEN '0' ELSE replace(cuenta_real, '-', '') END"
_IVR_TEXT = q.case_map("estado", {k: v for k, v in fixed.DIALER_TEXT.items() if k not in fixed.DIALER_ONLY_PREDICTIVE}, "estado")


def _touch_sql(channel: str, resource: str, where: str = "", brand: str = "marca") -> str:
    return (
        f"SELECT {_ACCOUNT} AS cuenta, min({brand}) AS marca, CAST(count(*) AS BIGINT) AS cantidad, '{resource}' AS recurso FROM contactos "
        f"WHERE canal = '{channel}' {where} GROUP BY 1"
    )


@query(
    "b12_channel_touches",
    " UNION ALL ".join(
        [
            _touch_sql("click", "Mensajeria"),
            _touch_sql("view", "EMAIL", f"AND {_ACCOUNT} <> '0'"),
            _touch_sql("signup", "BOT"),
            _touch_sql("error", "IVR", f"AND {_IVR_TEXT} IN {q.in_list(fixed.IVR_COUNTED)}",
                       "CASE WHEN marca IS NULL OR trim(marca) = '' THEN '0' ELSE marca END"),
        ]
    ),
)
def all_touches(t):
    rows = t.contactos.select("canal", F.col("cuenta_real").alias("cuenta"), "marca", "estado")
    channels = {"sms": "click", "email": "view", "bot": "signup", "ivr": "error"}
    return monthly.channel_touches({name: rows.filter(F.col("canal") == c) for name, c in channels.items()})


_VALUE = "TRY_CAST(replace(valor, ',', '.') AS DOUBLE)"
_PAYMENTS = f"""
    pagados AS (SELECT split_part(replace(obligacion, '.', ''), ',', 1) AS obligacion, {q.payment_date('fecha')} AS fecha, {_VALUE} AS valor_decimal,
      archivo AS origen FROM pagos WHERE tipo_operacion IS DISTINCT FROM 'AJUSTE' AND coalesce({_VALUE}, 0) >= 0.01)
"""


@query(
    "b13_payment_load",
    f"WITH {_PAYMENTS} SELECT obligacion, '' AS identificacion, CAST(fecha AS VARCHAR) AS fecha, CAST(trunc(valor_decimal) AS BIGINT) AS valor, '' AS asesor "
    "FROM (SELECT DISTINCT * FROM pagados) WHERE trunc(valor_decimal) > 0 AND fecha >= DATE '2001-06-01'",
)
def payment_load(t):
    """Every payment twice in its file: it is loaded once."""
    loaded = payments.payment_load(payments.cleaned_payments(t.pagos.unionAll(t.pagos)), AS_OF)
    return loaded.withColumn("fecha", F.col("fecha").cast("string"))


_PAYMENT_FILES = """
    SELECT CAST(orden AS VARCHAR) AS obligacion, fecha_iso AS fecha FROM base
    UNION ALL SELECT CAST(orden AS VARCHAR), fecha_iso FROM base WHERE origen = 'RR'
"""


@query(
    "b13_payment_files",
    f"SELECT obligacion, fecha, CAST(count(*) AS BIGINT) AS filas, 10.5 * count(*) AS valor FROM ({_PAYMENT_FILES}) GROUP BY 1, 2",
)
def payment_files(t):
    """Three layouts, separators and folders; the third names collection houses and holds other campaigns too."""
    folder = new_path(t.spark, "b13")
    rows = t.base.select(F.col("orden").cast("string").alias("orden"), "marca", "origen", "fecha_iso", F.lit("10.5").alias("pago"))
    first = rows.filter("marca <> 'churn'").selectExpr("orden AS Cuenta", "pago AS Pago", "fecha_iso AS Fecha")
    second = rows.filter("marca = 'churn'").selectExpr("fecha_iso AS FECHA_INGRESO", "orden AS `Número de Cliente`", "pago AS MONTO")
    code = F.when(F.col("origen") == "RR", fixed.OWN_CAMPAIGN_CODE).otherwise("UNIF - OTRA").alias(fixed.CAMPAIGN_CODE_COLUMN)
    third = rows.select(F.col("orden").alias("CUENTA"), F.col("pago").alias("Fecha de Creación"), F.col("fecha_iso").alias(fixed.HOUSE_COLUMN), code)
    for name, table, sep in (("a", first, ";"), ("b", second, ","), ("c", third, "\t")):
        stage_csv(table, f"{folder}/{name}", sep=sep)
    read = payments.read_payments(t.spark, folder)
    return read.groupBy("obligacion", "fecha").agg(F.count("*").alias("filas"), F.sum(F.col("valor").cast("double")).alias("valor"))


@query(
    "b13_payment_detail",
    f"WITH {_PAYMENTS} SELECT obligacion, CAST(fecha AS VARCHAR) AS fecha, valor_decimal, min(origen) AS origen FROM pagados GROUP BY 1, 2, 3",
)
def payment_detail(t):
    detail = payments.payment_detail(payments.cleaned_payments(t.pagos))
    return detail.withColumn("fecha", F.col("fecha").cast("string"))


_UNAPPLIED = """
    filas AS (SELECT right(replace(CAST(1000000000 + o_custkey AS VARCHAR) || '.' || o_orderkey % 3, '.', ''), 9) AS cuenta,
      replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS valor, 'a' || o_orderkey % 4 AS archivo,
      CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dia FROM orders),
    dias AS (SELECT cuenta, dia, min_by(valor, valor) AS valor FROM filas GROUP BY 1, 2)
"""


def unapplied(t):
    rows = t.orders.selectExpr(
        "CAST(1000000000 + o_custkey AS STRING) || '.' || o_orderkey % 3 AS CUSTCODE",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS MONTO",
        "'a' || o_orderkey % 4 AS archivo",
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS fecha_archivo",
    )
    return payments.unapplied_payments(rows)


@query("b14_unapplied_counts", f'WITH {_UNAPPLIED} SELECT cuenta AS "CUENTA", CAST(count(*) AS BIGINT) AS "RECUENTO" FROM dias GROUP BY 1')
def unapplied_counts(t):
    return unapplied(t)[0]


@query(
    "b14_unapplied_payments",
    f'WITH {_UNAPPLIED} SELECT cuenta AS "CUENTA", valor AS "VALOR", min(dia) AS "FILE_DATE" FROM dias GROUP BY 1, 2',
)
def unapplied_singles(t):
    return unapplied(t)[2]


@query(
    "b15_no_management",
    """
    SELECT replace(replace(cuenta_real, '-', ''), '.', '') AS "CUENTA", CAST(count(DISTINCT dia) AS BIGINT) AS "RECUENTO" FROM contactos
    WHERE regexp_full_match(replace(replace(cuenta_real, '-', ''), '.', ''), '[0-9]+') GROUP BY 1
    """,
)
def unmanaged(t):
    two, three = t.contactos.select("cuenta_real", "dia"), t.contactos.select("cuenta_real", "dia", "canal")
    (listed,) = payments.two_column_files([two, three])
    return payments.no_management(listed, "cuenta_real", "dia")


_RANK_STATE = "CASE WHEN orden % 4 = 0 THEN 'no' WHEN orden % 4 = 1 THEN 'si' WHEN orden % 4 = 2 THEN 'ajuste' ELSE 'Gestión_Recaudo' END"


@query(
    "b16_ranking",
    f"""
    WITH filas AS (SELECT *, {_RANK_STATE} AS e, replace(regexp_replace(CAST(identificacion AS VARCHAR) || '.0', '\\.0$', ''), '.', '') AS c FROM base WHERE orden % 3 <> 0),
    movil AS (SELECT c, CAST(count(*) OVER (PARTITION BY c) AS VARCHAR) AS s, upper(e || 'movil') AS k, orden % 7 AS pago, NULL AS f FROM filas WHERE orden % 2 = 0),
    fija AS (SELECT c, cant_servicios AS s, upper(e || 'fija') AS k, 0 AS pago, fecha_iso AS f FROM filas WHERE orden % 2 = 1),
    todo AS (SELECT * FROM movil UNION ALL SELECT * FROM fija)
    SELECT DISTINCT c AS "CUENTA", s AS "SERVICIOS", CASE WHEN k = 'NOFIJA' THEN 'NO RECUPERADA' WHEN k = 'SIFIJA' THEN 'RECUPERADA' WHEN k = 'NOMOVIL' THEN 'NO GESTIONAR'
      WHEN k IN ('SIMOVIL', 'AJUSTEMOVIL') THEN 'GESTIONAR' WHEN contains(k, 'GESTIÓN_RECAUDO') THEN 'GESTION RECAUDO' ELSE k END AS "ESTADO", pago AS "PAGO",
      f AS "FECHA", CAST(NULL AS VARCHAR) AS "CONCEPTO" FROM todo
    """,
)
def rankings(t):
    agency = F.when(F.col("orden") % 3 == 0, "OTRA").otherwise("Agencia Norte")
    rows = t.base.withColumns({"agencia": agency, "estado": F.expr(_RANK_STATE), "c": F.concat("identificacion", F.lit(".0"))})
    mobile = rows.filter("orden % 2 = 0").selectExpr("c AS Raiz", "agencia AS `Casa Cobro`", "estado AS Gestion", "orden % 7 AS Pago")
    fixed_line = rows.filter("orden % 2 = 1").selectExpr(
        "c AS CUENTA", "agencia AS Aliado", "estado AS Recuperada", "cant_servicios AS `N Servicios`", "fecha_iso AS `Fecha de Pago`"
    )
    return payments.ranking([mobile, fixed_line], "agencia norte")


@query(
    "b17_exclusion_lists",
    """
    SELECT DISTINCT * FROM (SELECT 'documento' AS entidad, regexp_replace(documento, '[^0-9]', '', 'g') AS valor FROM base
      UNION ALL SELECT 'cuenta', regexp_replace(cuenta, '[^0-9]', '', 'g') FROM base UNION ALL SELECT 'telefono', regexp_replace(celular4, '[^0-9]', '', 'g') FROM base
      UNION ALL SELECT 'correo', regexp_replace(email1, '[ <>]', '', 'g') FROM base) WHERE valor <> ''
    """,
)
def exclusions(t):
    return contactcenter.exclusion_lists(
        t.base, {"documento": "documento", "cuenta": "cuenta", "telefono": "celular4", "correo": "email1"}
    )


@query(
    "b17_exclusion_sources",
    r"""
    SELECT DISTINCT * FROM (SELECT 'telefono' AS entidad, CASE WHEN length(d) BETWEEN 3 AND 12 THEN d END AS valor FROM (SELECT regexp_replace(celular4, '[^0-9]', '', 'g') AS d FROM base)
      UNION ALL SELECT 'telefono', '604' || substr(fijo2, 1, 7) FROM base WHERE fijo2 <> ''
      UNION ALL SELECT 'documento', CASE WHEN length(d) > 2 THEN d END FROM (SELECT regexp_replace(documento, '[^0-9]', '', 'g') AS d FROM base)
      UNION ALL SELECT 'correo', CASE WHEN length(c) - length(replace(c, '@', '')) = 1 THEN c END FROM (SELECT lower(regexp_replace(trim(email1), '[^\w.@-]', '', 'g')) AS c FROM base))
    WHERE valor IS NOT NULL
    """,
)
def exclusion_sources(t):
    return contactcenter.exclusion_sources(
        t.base.select(F.col("celular4").alias("telefono")),
        t.base.select(F.lit("4").alias("area"), F.substring("fijo2", 1, 7).alias("numero")),
        t.base.select("documento"),
        t.base.select(F.col("email1").alias("correo")),
    ).select("entidad", F.col("valor"))


@query(
    "b18_complaints",
    """
    SELECT DISTINCT replace(cuenta, '-', '') AS "CUENTA", '2001-06-15' AS "FECHA" FROM base
    WHERE mejorperfil = 'Reclamacion' AND ultimoperfil = 'Reclamacion' AND perfil_historico = 'Reclamacion'
    """,
)
def complaints(t):
    return contactcenter.complaint_exclusion(t.base, "cuenta", ["mejorperfil", "ultimoperfil", "perfil_historico"], AS_OF)


def load_rows(t):
    return t.base.select(
        "documento", "cuenta", "origen", "marca5", "marca6", "marca7", F.col("Mod_init_cta").alias("deuda"),
        F.col("nombre_campana").alias("campana"), "edad", F.col("nombrecompleto").alias("nombre"), F.col("ciudad").alias("corrida"),
        F.col("fecha_corta").alias("vencimiento"), "referencia", F.col("customer_type_id").alias("tipo_cliente"), "refinanciada",
        "celular1", "celular2", "fijo1",
    )


_VALID_LOAD = "coalesce(TRY_CAST(customer_type_id AS INT) BETWEEN 80 AND 89, false) AND ciudad IS NOT NULL AND referencia IS NOT NULL"
_PLAIN_ACCOUNT = "replace(replace(cuenta, '-', ''), '.', '')"
_CLIENT = "CAST(coalesce(TRY_CAST(regexp_replace(documento, '[^0-9]', '', 'g') AS BIGINT), 0) AS VARCHAR)"
_LITERAL = q.clean_name_literal("nombrecompleto")


@query(
    "b19_load_file",
    f"""
    WITH filas AS (SELECT *, {_VALID_LOAD} AS valida, CASE WHEN refinanciada = 'Y' AND (marca5 = 'Y' OR marca6 = 'Y' OR marca7 = 'Y') THEN '' ELSE refinanciada END AS marca_ref,
      {_LITERAL} AS limpio FROM base),
    rutas AS (SELECT 'cargue' AS ruta, * FROM filas WHERE valida UNION ALL SELECT 'multimarca', * FROM filas WHERE valida AND marca7 <> 'Y'
      UNION ALL SELECT 'actualizacion', * FROM filas WHERE valida AND marca7 <> 'Y' UNION ALL SELECT 'errores', * FROM filas WHERE NOT valida)
    SELECT ruta, CASE WHEN ruta = 'actualizacion' THEN {_PLAIN_ACCOUNT} ELSE cuenta END AS cuenta, CASE WHEN ruta <> 'actualizacion' THEN documento
      WHEN length({_CLIENT}) < 2 THEN {_PLAIN_ACCOUNT} ELSE {_CLIENT} END AS cliente, CASE WHEN length(limpio) < 7 THEN nombrecompleto ELSE limpio END AS nombre,
      {q.document_type('documento')} AS tipo_documento, marca_ref AS refinanciada,
      CASE WHEN ruta = 'actualizacion' THEN CAST({q.slash_date('fecha_corta')} AS VARCHAR) ELSE fecha_corta END AS vencimiento FROM rutas
    """,
)
def load_file(t):
    rows = assignment.load_file(load_rows(t))
    return rows.select("ruta", "cuenta", "cliente", "nombre", "tipo_documento", "refinanciada", "vencimiento")


@query(
    "b19_create_file",
    f"""
    WITH filas AS (SELECT cuenta, {_PLAIN_ACCOUNT} AS cuenta_next, origen, regexp_replace(coalesce(celular1, '') || ',' || coalesce(celular2, '') || ',' || coalesce(fijo1, ''), ',,+', ',', 'g')
      AS lineas, {_BRAND} AS marca, CASE WHEN customer_type_id IN ('81','84','87') THEN 'Personas' ELSE 'Negocios' END AS segmento, {q.debt_band('Mod_init_cta')} AS rango,
      replace(Mod_init_cta, '.', ',') AS saldo, {q.base_type('nombre_campana')} AS tipo_base, {q.document_type('documento')} AS tipo_documento FROM base)
    SELECT 'multiorigen' AS ruta, * FROM filas UNION ALL SELECT 'corporativos', * FROM filas WHERE tipo_base = 'CLIENTES CORPORATIVOS'
    UNION ALL SELECT 'multimarca', * FROM filas WHERE marca <> 'Castigo' AND tipo_base <> 'CLIENTES CORPORATIVOS'
    UNION ALL SELECT 'castigo', * FROM filas WHERE marca = 'Castigo' UNION ALL SELECT 'con_origen', * FROM filas
    """,
)
def create_file(t):
    return assignment.create_file(load_rows(t), ["celular1", "celular2", "fijo1"])


_AREA_OF = "CASE " + " ".join(
    f"WHEN lugar IN {q.in_list(places)} THEN '{digit}'" for digit, places in fixed.AREA_BY_PLACE.items()
) + " END"


@query(
    "b20_assignment_contacts",
    f"""
    WITH b AS (SELECT orden, CAST(identificacion AS BIGINT) AS identificacion, cuenta, ciudad, marca, celular1, celular4, substr(fijo1, 1, CAST(7 + orden % 4 AS INT)) AS corto,
      email1, email2, split_part(regexp_replace(split_part(CASE WHEN ciudad IS NULL OR ciudad = '' THEN 'BOGOTA' ELSE ciudad END, '/', 1), '[^A-Z ]', '', 'g'), ' ', 1) AS lugar FROM base),
    n AS (SELECT *, replace(d, 'sin dato', 'sindato') AS limpio, {_AREA_OF} AS area FROM (SELECT *, UNNEST([celular1, celular4, corto]) AS d FROM b) WHERE d IS NOT NULL),
    a AS (SELECT *, CASE length(limpio) WHEN 7 THEN '60' || area || limpio WHEN 8 THEN '60' || limpio END AS armado FROM n),
    t AS (SELECT identificacion, cuenta, ciudad, marca, 'telefono' AS tipodato, CASE WHEN TRY_CAST(limpio AS BIGINT) BETWEEN 3000000001 AND 3599999998 OR
      TRY_CAST(limpio AS BIGINT) BETWEEN 6010000001 AND 6089999998 THEN limpio WHEN area IS NOT NULL AND (TRY_CAST(limpio AS BIGINT) <= 3000000000 OR TRY_CAST(limpio AS BIGINT)
      BETWEEN 3599999999 AND 6010000000) AND (TRY_CAST(armado AS BIGINT) BETWEEN 6010000000 AND 6089999998) THEN armado END AS dato FROM a),
    e AS (SELECT identificacion, cuenta, ciudad, marca, 'email' AS tipodato, correo AS dato FROM (SELECT *, UNNEST([email1, email2]) AS correo FROM b) WHERE contains(correo, '@')
      AND {EMAIL_QUALITY} <> 'ERRADO'),
    r AS (SELECT * FROM t WHERE dato IS NOT NULL UNION ALL SELECT * REPLACE (lower(dato) AS dato) FROM e)
    SELECT DISTINCT identificacion, {_PLAIN_ACCOUNT} AS cuenta, ciudad, marca, tipodato, dato FROM r
    """,
)
def contacts_of_assignment(t):
    short = F.substring(F.col("fijo1"), F.lit(1), (F.lit(7) + F.col("orden") % 4).cast("int"))
    rows = t.base.withColumn("corto", short)
    return assignment.assignment_contacts(rows, ["celular1", "celular4", "corto"], ["email1", "email2"])


_DIALER = f"""
    SELECT DISTINCT 'No contacto' AS gestion, 'Predictivo' AS usuario, dia AS fechagestion, 'Hacer llamada' AS accion,
      {q.case_map('estado', fixed.DIALER_PROFILE, "'error'")} AS perfil, telefono AS numeromarcado, cuenta AS identificacion, cuenta_real AS cuenta_promesa,
      CASE WHEN length(cuenta_real) < 3 THEN 'Sin cuenta' WHEN estado IN {q.in_list(fixed.DIALER_INEFFECTIVE)} THEN 'No efectivo' WHEN estado = 'NEW' THEN 'Sin marcar'
      ELSE 'Efectivo' END AS "Filtro_BATCH", {q.case_map('estado', fixed.DIALER_TEXT, "'error'")} AS "TIPOLOGIA", telefono || cuenta AS "CRUCE" FROM contactos
"""


def dialer_rows(t):
    return contactcenter.dialer_result(
        t.contactos.select(
            F.col("momento").alias("last_local_call_time"), F.col("estado").alias("status"), F.col("cuenta").alias("vendor_lead_code"),
            F.col("telefono").alias("phone_number"), F.col("cuenta_real").alias("address1"),
        )
    )


@query("b21_dialer_result", _DIALER)
def dialer(t):
    return dialer_rows(t)


_CROSS_LAKE = """
    SELECT DISTINCT telefono || cuenta AS llave, 'C' || cuenta AS c FROM contactos WHERE
      CASE evento % 3 WHEN 0 THEN '60' ELSE 'churn' END NOT IN ('60', '90', '120', '150', '180', '210', 'Castigo', 'Provision', 'Preprovision')
"""


@query(
    "b22_batch_cross",
    f"""
    WITH d AS ({_DIALER}), l AS ({_CROSS_LAKE}), n AS (SELECT * EXCLUDE (cuenta_promesa) FROM d WHERE "Filtro_BATCH" = 'No efectivo')
    SELECT DISTINCT n.*, c AS cuenta_promesa, true AS cruza FROM n JOIN l ON llave = "CRUCE"
    UNION ALL SELECT DISTINCT n.*, NULL, false FROM n WHERE "CRUCE" NOT IN (SELECT llave FROM l)
    """,
)
def crossed(t):
    lake = t.contactos.select(
        F.col("telefono").alias("dato"), F.col("cuenta").alias("identificacion"), F.concat(F.lit("C"), "cuenta").alias("cuenta"),
        F.when(F.col("evento") % 3 == 0, "60").otherwise("churn").alias("marca"),
    )
    results = dialer_rows(t)
    found = contactcenter.batch_cross(results, lake).withColumn("cruza", F.lit(True))
    return found.unionByName(contactcenter.batch_cross(results, lake, want=False).withColumn("cruza", F.lit(False)))


@query(
    "b23_bot_result",
    f"""
    WITH u AS (SELECT * FROM contactos QUALIFY row_number() OVER (PARTITION BY cuenta, canal, disposicion ORDER BY evento) = 1),
    r AS ({BOT_SQL})
    SELECT principal AS "FILTRO__PRINCIPAL", canal AS "TELEFONO", cuenta AS "CUENTA", tipologia AS "TIPOLOGIA", identidad AS "FILTRO_IDENTIDAD", pago AS "FILTRO_PAGO"
    FROM u JOIN r USING (evento)
    """,
)
def bot_results(t):
    rows = t.contactos.select(
        "evento", F.col("canal").alias("phone"), F.col("cuenta").alias("CUENTA"), F.col("disposicion").alias("disposition"),
        F.col("identidad").alias("ans_validacion_identidad"), F.col("pago").alias("ans_validacion_pago"),
        F.lit("1").alias("attempts"), F.lit("10").alias("duration"),
    )
    return contactcenter.bot_result(rows, ["evento"])


@query(
    "b24_lake_types",
    """
    SELECT CASE WHEN length(demographic) = 10 AND demographic LIKE '6%' THEN 'fijo' WHEN length(demographic) = 10 AND demographic LIKE '3%' THEN 'movil'
      WHEN contains(demographic, '@') THEN 'email' ELSE 'errado' END AS type, CAST(count(*) AS BIGINT) AS cantidad FROM
      (SELECT account, demographic FROM lago UNION SELECT account, demographic FROM nuevos) GROUP BY 1
    """,
)
def lake_types(t):
    return contactcenter.lake_update(t.lago, t.nuevos)[1]


@query(
    "b24_lake_new_records",
    """
    WITH n AS (SELECT document, account, CASE WHEN contains(demographic, '@') THEN demographic ELSE regexp_replace(regexp_replace(demographic, '[^0-9]', '', 'g'), '^0+', '') END
      AS demographic FROM nuevos), k AS (SELECT *, CASE WHEN contains(demographic, '@') THEN 'email' WHEN length(demographic) = 10 AND demographic LIKE '3%' THEN 'movil'
      WHEN length(demographic) = 10 AND demographic LIKE '6%' THEN 'fijo' ELSE 'errado' END AS type FROM n)
    SELECT DISTINCT * FROM k WHERE type <> 'errado' AND NOT EXISTS (SELECT 1 FROM lago l WHERE l.account = k.account AND l.demographic = k.demographic)
    """,
)
def lake_new(t):
    return contactcenter.lake_new_records(t.nuevos, t.lago)


_OWN = ("otra", "sms_1", "CLARO")


@query("b25_invoicing_fact", VOLUME_FACT_SQL)
def invoicing(t):
    tables = [(t.envios, spec) for spec in volume_specs()]
    return shown_time(contactcenter.vendor_facts(tables, *_OWN)[0])


@query(
    "b25_campaign_fact",
    f"""
    SELECT * REPLACE ({q.unified_group('agrupador', "WHEN contains(lower(agrupador), 'otra') AND fuente = 'sms_1' THEN 'CLARO'")} AS agrupador),
      valor_movimiento AS registros FROM ({_fact_sql('hour')})
    """,
)
def campaign_fact(t):
    tables = [(t.envios, spec) for spec in volume_specs()]
    return shown_time(contactcenter.vendor_facts(tables, *_OWN)[1])


_REPORTS = {
    "sms_1": {"fecha de inicio": "momento", "nombre de usuario": "campana", "enviados": "valor"},
    "ivr_1": {"fecha_inicio": "momento", "nombre_campana": "campana", "segundos": "valor", "audio": "tipo"},
    "ivr_2": {"connect time": "momento", "account name": "campana", "tiempo facturado": "valor", "costo": "costo"},
    "email": {"fecha de envío": "momento", "remitente": "remitente", "procesados": "valor"},
    "sms_2": {"fecha programado": "momento", "campaña": "campana", "total procesados": "valor"},
    "bot_base": {"fecha_llamada": "momento", "campaña": "campana", "tiempo_llamada": "valor", "estado_llamada": "estado_llamada"},
}


def _report_fact_sql(unit: str) -> str:
    given = {
        "sms_1": ("campana", "", "", ""), "ivr_1": (_KEYWORDS["ivr_1"], "", "tipo", ""), "ivr_2": (_KEYWORDS["ivr_2"], "", "", "costo"),
        "email": ("remitente", "", "", ""), "sms_2": (_KEYWORDS["sms_2"], "", "", ""),
        "bot_base": ("campana", "AND lower(coalesce(estado_llamada, 'nan')) <> 'contestadora'", "", ""),
    }
    parts = " UNION ALL ".join(_volume_sql(unit, s, g, w, e, c) for s, (g, w, e, c) in given.items())
    return f"SELECT * REPLACE ({q.unified_group('agrupador')} AS agrupador) FROM ({parts})"


def report_folder(t) -> str:
    """All events as the reports of six vendors, each with its own header; a seventh layout is unknown."""
    folder = new_path(t.spark, "b25")
    layouts = dict(reversed(fixed.VENDOR_LAYOUTS)) | {"bot_base": fixed.BOT_BASE_BY_CALL}
    for kind, given in _REPORTS.items():
        rows = t.envios.selectExpr(*[f"{given.get(c, 'NULL')} AS `{c}`" for c in layouts[kind]])
        stage_csv(rows.select([F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]), f"{folder}/{kind}", sep=";")
    stage_csv(t.envios.selectExpr("evento AS otra", "valor AS cosa"), f"{folder}/otra", sep=";")
    return folder


@query("b25_report_folder_days", _report_fact_sql("day"))
def report_days(t):
    return shown_time(vendors.vendor_folder_facts(t.spark, report_folder(t))[0])


@query("b25_report_folder_hours", f"SELECT *, valor_movimiento AS registros FROM ({_report_fact_sql('hour')})")
def report_hours(t):
    return shown_time(vendors.vendor_folder_facts(t.spark, report_folder(t))[1])


@query(
    "b26_sent_buckets",
    """
    SELECT 'base_' || sello || '_0930.csv' AS "Archivo", min(fecha_iso) AS "Fecha", '09:30' AS "Hora", CASE WHEN regexp_full_match(marca, '[0-9]+') THEN 'MORA ' || marca
      ELSE upper(marca) END AS "Mora", 'SMS' AS "Tipo", CAST(count(*) AS BIGINT) AS "Cantidad", 'CAMPANA' AS "Campana" FROM
      (SELECT marca, fecha_iso, substr(fecha_iso, 9, 2) || substr(fecha_iso, 6, 2) || substr(fecha_iso, 1, 4) AS sello FROM base) GROUP BY 1, 4
    """,
)
def sent_buckets(t):
    stamp = "substr(fecha_iso, 9, 2) || substr(fecha_iso, 6, 2) || substr(fecha_iso, 1, 4)"
    rows = t.base.selectExpr("marca", f"'base_' || {stamp} || '_0930.csv' AS archivo")
    return contactcenter.sent_bucket_summary(rows, "marca", "archivo", "SMS", "CAMPANA")


@query(
    "b27_agent_time",
    'SELECT cuenta AS "Usuario", CAST(count(*) AS BIGINT) AS "LLAMADAS", \'\' AS "BREAK", \'\' AS identificacion, \'14/06/2001\' AS "Fecha" FROM contactos GROUP BY 1',
)
def agent_times(t):
    calls = t.contactos.groupBy(F.col("cuenta").alias("Usuario")).agg(F.count("*").alias("LLAMADAS"))
    return contactcenter.agent_time(calls, AS_OF).select("Usuario", "LLAMADAS", "BREAK", "identificacion", "Fecha")


@query(
    "b28_dashboard",
    f"""
    SELECT identificacion AS "Identificacion", replace(cuenta, '-', '') AS "Cuenta_Next", marca AS "Edad_Mora", marca AS "marca2", {q.case_map(
        'producto', fixed.ORIGIN_LABELS['dashboard'], 'producto')} AS "CRM", producto AS "PRODUCTO", replace(Mod_init_cta, '.', ',') AS "Saldo_Asignado",
      CASE plan WHEN 'A' THEN 'PERSONASS' WHEN 'B' THEN 'PERSONAS' ELSE 'NEGOCIOS' END AS "Segmento", '2001-06' AS "Fecha_Asignacion", '10' AS "Hora_Envio",
      CAST(NULL AS VARCHAR) AS "SMS" FROM (SELECT *, {q.case_map('origen', fixed.ORIGIN_LABELS['sms'], 'origen')} AS producto FROM base)
    """,
)
def dashboards(t):
    product = q.case_map("origen", fixed.ORIGIN_LABELS["sms"], "origen")
    rows = t.base.selectExpr(
        "identificacion AS IDENTIFICACION", "cuenta AS CUENTA", "marca AS MORA", f"{product} AS PRODUCTO", "Mod_init_cta AS MOD_INIT_CTA",
        "CASE plan WHEN 'A' THEN 'No aplica' WHEN 'B' THEN 'persona' ELSE 'negocios' END AS SEGMENTO", "'10:30' AS HORA_EJECUCION",
    )
    return contactcenter.dashboard(rows, AS_OF).select(
        "Identificacion", "Cuenta_Next", "Edad_Mora", "marca2", "CRM", "PRODUCTO", "Saldo_Asignado", "Segmento", "Fecha_Asignacion", "Hora_Envio", "SMS"
    )


@query(
    "b29_demographics_union",
    """
    SELECT cuenta, dato, min(identificacion) AS identificacion FROM (SELECT account AS cuenta, demographic AS dato, document AS identificacion FROM lago
      UNION ALL SELECT account, demographic, document FROM nuevos) GROUP BY 1, 2
    """,
)
def demographic_union(t):
    names = {"account": "cuenta", "demographic": "dato", "document": "identificacion"}
    return contactcenter.demographics_union([t.lago.withColumnsRenamed(names), t.nuevos.withColumnsRenamed(names)])


_SOUGHT = ("BOGOTA", "1234", "ASCARD", "nunca")
_SOUGHT_LIST = "[" + ", ".join(q.quote(term) for term in _SOUGHT) + "]"


@query(
    "b29_search_folder",
    f"""
    WITH filas AS (SELECT cuenta AS a, ciudad AS b, 'x' AS archivo FROM base WHERE orden % 2 = 0 UNION ALL SELECT cuenta, origen, 'y' FROM base WHERE orden % 2 = 1),
    t AS (SELECT UNNEST({_SOUGHT_LIST}) AS termino), h AS (SELECT termino, archivo FROM filas, t WHERE contains(a, termino) OR contains(coalesce(b, ''), termino)),
    g AS (SELECT termino, count(*) AS n, count(DISTINCT archivo) AS f FROM h GROUP BY 1)
    SELECT t.termino AS "Dato_Buscado", CASE WHEN n > 0 THEN 'SI' ELSE 'NO' END AS "Encontrado", CAST(coalesce(n, 0) AS BIGINT) AS "Total_Coincidencias",
      CASE WHEN n > 0 THEN 'ENCONTRADO' ELSE 'NO_ENCONTRADO' END AS "Estado", CAST(coalesce(f, 0) AS BIGINT) AS "Archivos_Con_Coincidencias"
    FROM t LEFT JOIN g USING (termino)
    """,
)
def searched_folder(t):
    """Two layouts in different subfolders, one file each."""
    folder = new_path(t.spark, "b29")
    stage_csv(t.base.filter("orden % 2 = 0").select("cuenta", "ciudad").coalesce(1), f"{folder}/a")
    stage_csv(t.base.filter("orden % 2 = 1").select("origen", "cuenta").coalesce(1), f"{folder}/b", sep=",")
    return contactcenter.search_folder(t.spark, folder, _SOUGHT)[1]


@query(
    "b30_accounts_per_document",
    f"""
    SELECT identificacion, CAST(0 AS BIGINT) AS parte, string_agg(cuenta, ';' ORDER BY cuenta) AS "Cuentas" FROM
      (SELECT DISTINCT identificacion, replace(cuenta, '-', '') || '_' AS cuenta FROM base WHERE marca IN {q.in_list(fixed.LISTED_BRANDS)}) GROUP BY 1
    """,
)
def document_accounts(t):
    return contactcenter.accounts_per_document(t.base)


@query(
    "b30_login_log",
    """
    SELECT cuenta, dia AS fecha, '08:00' AS usuhoraentrada, CAST(evento AS VARCHAR) AS usuhorasalida FROM contactos
    """,
)
def logins(t):
    rows = t.contactos.selectExpr(
        "cuenta", "dia || ' 00:00:00' AS fecha", "'08:00,12:00' AS usuhoraentrada", "'12:00,' || evento AS usuhorasalida"
    )
    return contactcenter.login_log(rows)


@query(
    "b30_brand_payments",
    'SELECT marca AS "Marca", cuenta2 AS "CUENTA NEXT", replace(valor, \'.\', \',\') AS "VALOR PAGO" FROM base JOIN '
    "(SELECT orden AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS valor FROM base JOIN orders ON o_orderkey = orden) ON k = orden",
)
def brand_payment_folders(t):
    """Written by brand in the fixed layout and read back."""
    given = {"Marca": "marca", "CUENTA NEXT": "cuenta2", "VALOR PAGO": "valor"}
    paid = t.orders.selectExpr("o_orderkey AS orden", "replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',') AS valor")
    rows = t.base.select("orden", "marca", "cuenta2").join(paid, "orden")
    full = rows.selectExpr(*[f"{given.get(c, repr(''))} AS `{c}`" for c in fixed.BRAND_PAYMENT_COLUMNS])
    path = new_path(t.spark, "b30")
    payments.brand_payments(full, path)
    names = [c for c in fixed.BRAND_PAYMENT_COLUMNS if c != "Marca"]
    stored = t.spark.read.schema(text_schema(names)).options(header=True, sep=";", recursiveFileLookup="true").csv(path)
    brand = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "Marca=([^/]*)/", 1))
    return stored.select(brand.alias("Marca"), "CUENTA NEXT", "VALOR PAGO")
