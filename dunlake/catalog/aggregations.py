"""Aggregations A1-A14, W5, the calendar C1-C2 and layout operators over the stand-in views."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from dunlake.catalog import sqltext as q
from dunlake.catalog.registry import query
from dunlake.functions import fixed_values as fixed
from dunlake.functions import classes, contacts
from dunlake.operators import aggregates as a
from dunlake.operators import calendar as cal
from dunlake.operators.reshape import filled_slots
from dunlake.sources.layouts import find_column

_TOUCHED = "CASE WHEN cuenta_real IS NULL OR trim(cuenta_real) = '' THEN '0' ELSE replace(cuenta_real, '-', '') END"


@query(
    "a1_touch_count",
    f"""
    SELECT {_TOUCHED} AS cuenta, min(marca) AS marca, CAST(count(*) AS BIGINT) AS cantidad, 'BOT' AS recurso FROM contactos
      GROUP BY 1
    UNION ALL SELECT {_TOUCHED}, min(marca), CAST(count(*) AS BIGINT), 'EMAIL' FROM contactos WHERE {_TOUCHED} <> '0' GROUP BY 1
    """,
)
def touch_counts(t):
    account = classes.touched_account("cuenta_real")
    bot = a.touch_count(t.contactos, account, "marca", "BOT")
    email = a.touch_count(t.contactos, account, "marca", "EMAIL", drop_zero=True)
    return bot.unionByName(email)


_GROUP = q.case_map("replace(lower(perfil), ' ', '')", fixed.PROFILE_GROUPS, "NULL")
MIX_SQL = f"""
    SELECT cuenta, d AS contacto_directo, i AS contacto_indirecto, n AS no_contacto, trim(CASE WHEN d > 0 THEN 'CDIR ' ELSE '' END ||
      CASE WHEN i > 0 THEN 'CIND ' ELSE '' END || CASE WHEN n > 0 THEN 'NOC' ELSE '' END) AS mezcla FROM (
    SELECT cuenta, CAST(count(*) FILTER (g = 'CDIR') AS BIGINT) AS d, CAST(count(*) FILTER (g = 'CIND') AS BIGINT) AS i,
      CAST(count(*) FILTER (g = 'NOC') AS BIGINT) AS n FROM (SELECT cuenta, {_GROUP} AS g FROM contactos) GROUP BY 1)
"""


@query("a2_contact_mix", MIX_SQL)
def contact_mixes(t):
    return a.contact_mix(t.contactos, "cuenta", "perfil")


@query(
    "a3_multi_flags",
    """
    WITH g AS (SELECT identificacion AS i, count(*) AS c, count(DISTINCT origen) AS o, count(DISTINCT marca) AS m FROM base GROUP BY 1)
    SELECT orden, CASE WHEN c > 1 THEN 'Aplica' ELSE 'No aplica' END AS "MULTICUENTA", CASE WHEN o > 1 THEN 'Aplica' ELSE 'No aplica' END
      AS "MULTIPRODUCTO", CASE WHEN m > 1 THEN 'Aplica' ELSE 'No aplica' END AS "MULTIMORA" FROM base JOIN g ON i = identificacion
    """,
)
def multi_flags(t):
    rows = t.base.select("orden", "identificacion", "origen", "marca")
    return a.multi_flags(rows, "identificacion", "origen", "marca").drop("identificacion", "origen", "marca")


@query(
    "a4_global_max",
    "SELECT clave, max(dia) AS ultimo, (SELECT max(dia) FROM presencia) AS ultimo_de_todas FROM presencia GROUP BY 1",
)
def global_max(t):
    """The overall maximum is a scalar subquery: nothing goes through the driver."""
    last = t.presencia.agg(F.max("dia")).scalar()
    return t.presencia.groupBy("clave").agg(F.max("dia").alias("ultimo")).withColumn("ultimo_de_todas", last)


_RANKING = "CASE WHEN estado_ranking IS NULL OR estado_ranking = '' THEN 'NO APLICA FILTRO RANKING' ELSE estado_ranking END"
RETIRE_SQL = f"""
    WITH r AS (SELECT orden, marca, {_RANKING} AS estado FROM base)
    SELECT orden, marca, CASE WHEN estado = 'NO APLICA FILTRO RANKING' AND marca IN {q.in_list(fixed.SPECIAL_RANKING_BRANDS)} AND marca IN
      (SELECT marca FROM r WHERE estado <> 'NO APLICA FILTRO RANKING') THEN 'RETIRAR' ELSE estado END AS estado FROM r
"""


@query("a5_brand_retire_flag", RETIRE_SQL)
def retire_flags(t):
    rows = t.base.select("orden", "marca", classes.known_ranking("estado_ranking").alias("estado"))
    return a.brand_retire_flag(rows, "marca", "estado")


@query(
    "a6_recount",
    """
    WITH d AS (SELECT cuenta, dia, min(evento) AS evento FROM contactos GROUP BY 1, 2)
    SELECT cuenta, dia, evento, CAST(count(*) OVER (PARTITION BY cuenta) AS BIGINT) AS "RECUENTO" FROM d
    """,
)
def recounts(t):
    return a.recount(t.contactos.select("cuenta", "dia", "evento"), "cuenta", "dia", ["evento"])


@query(
    "a7_bucket_counts",
    """
    SELECT plan, CASE WHEN regexp_full_match(b, '[0-9]+') THEN 'MORA ' || b WHEN TRY_CAST(b AS DOUBLE) IS NOT NULL THEN 'MORA ' ||
      CAST(CAST(trunc(TRY_CAST(b AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE upper(b) END AS "Mora", CAST(count(*) AS BIGINT) AS "Cantidad"
    FROM (SELECT plan, CASE orden % 4 WHEN 0 THEN marca WHEN 1 THEN ' ' || edad WHEN 2 THEN edad || '.7' ELSE NULL END AS b0,
      trim(CASE orden % 4 WHEN 0 THEN marca WHEN 1 THEN ' ' || edad WHEN 2 THEN edad || '.7' ELSE NULL END) AS b FROM base)
    WHERE b IS NOT NULL GROUP BY 1, 2
    """,
)
def buckets(t):
    kind = F.col("orden") % 4
    bucket = (
        F.when(kind == 0, F.col("marca"))
        .when(kind == 1, F.concat(F.lit(" "), "edad"))
        .when(kind == 2, F.concat("edad", F.lit(".7")))
    )
    return a.bucket_counts(t.base.select("plan", bucket.alias("mora")), "mora", ["plan"])


def _volume_sql(unit: str, source: str, group: str, where: str = "", extra: str = "", cost: str = "", name: str = "dia") -> str:
    return f"""SELECT CAST(date_trunc('{unit}', TRY_CAST(momento AS TIMESTAMP)) AS VARCHAR) AS fecha_movimiento, {group} AS agrupador,
      {extra or 'CAST(NULL AS VARCHAR)'} AS tipo, CAST(sum(coalesce(TRY_CAST(valor AS DECIMAL(28,10)), 0)) AS DOUBLE) AS valor_movimiento,
      {'CAST(sum(coalesce(TRY_CAST(costo AS DECIMAL(28,10)), 0)) AS DOUBLE)' if cost else 'CAST(NULL AS DOUBLE)'} AS costo,
      '{source}' AS fuente FROM envios WHERE TRY_CAST(momento AS TIMESTAMP) IS NOT NULL {where} GROUP BY ALL"""


_KEYWORDS = {vendor: q.keyword_group("campana", rules) for vendor, rules in fixed.VENDOR_KEYWORDS.items()}
_FACT_PARTS = {
    "sms_1": ("campana", "AND canal = 'click'", "", ""),
    "ivr_1": (_KEYWORDS["ivr_1"], "AND canal = 'view'", "tipo", ""),
    "ivr_2": (_KEYWORDS["ivr_2"], "AND canal = 'error'", "", "costo"),
    "email": ("remitente", "AND canal = 'signup'", "", ""),
    "sms_2": (_KEYWORDS["sms_2"], "AND canal = 'purchase'", "", ""),
    "bot_base": ("campana", "AND lower(coalesce(estado_llamada, 'nan')) <> 'contestadora'", "", ""),
}


def _fact_sql(unit: str) -> str:
    return " UNION ALL ".join(_volume_sql(unit, s, g, w, e, c) for s, (g, w, e, c) in _FACT_PARTS.items())


def volume_specs():
    keyword = {vendor: classes.keyword_group("campana", rules) for vendor, rules in fixed.VENDOR_KEYWORDS.items()}
    not_machine = F.lower(F.coalesce("estado_llamada", F.lit("nan"))) != fixed.MACHINE_ANSWER
    return [
        a.VolumeSpec("sms_1", "momento", "campana", "valor", keep=F.col("canal") == "click"),
        a.VolumeSpec("ivr_1", "momento", keyword["ivr_1"], "valor", extra_group="tipo", keep=F.col("canal") == "view"),
        a.VolumeSpec("ivr_2", "momento", keyword["ivr_2"], "valor", cost="costo", keep=F.col("canal") == "error"),
        a.VolumeSpec("email", "momento", "remitente", "valor", keep=F.col("canal") == "signup"),
        a.VolumeSpec("sms_2", "momento", keyword["sms_2"], "valor", keep=F.col("canal") == "purchase"),
        a.VolumeSpec("bot_base", "momento", "campana", "valor", keep=not_machine),
    ]


def shown_time(df):
    return df.withColumn("fecha_movimiento", F.date_format("fecha_movimiento", "yyyy-MM-dd HH:mm:ss"))


@query("a8_daily_volume", _volume_sql("day", "ivr_1", _KEYWORDS["ivr_1"], extra="tipo").replace("CAST(NULL AS DOUBLE) AS costo,", ""))
def daily(t):
    return shown_time(a.daily_volume(t.envios, replace(volume_specs()[1], keep=None)))


@query(
    "a9_hourly_volume",
    "SELECT *, valor_movimiento AS registros FROM ("
    + _volume_sql("hour", "ivr_2", _KEYWORDS["ivr_2"], cost="costo").replace("CAST(NULL AS VARCHAR) AS tipo,", "") + ")",
)
def hourly(t):
    return shown_time(a.hourly_volume(t.envios, replace(volume_specs()[2], keep=None)))


VOLUME_FACT_SQL = f"""
    SELECT * REPLACE ({q.unified_group('agrupador', "WHEN contains(lower(agrupador), 'otra') AND fuente = 'sms_1' THEN 'CLARO'")} AS agrupador)
    FROM ({_fact_sql('day')})
"""


@query("a10_volume_fact", VOLUME_FACT_SQL)
def fact(t):
    parts = [a.daily_volume(t.envios, spec) for spec in volume_specs()]
    return shown_time(a.volume_fact(parts, own_name="otra", own_source="sms_1", own_group="CLARO"))


@query("a11_type_counts", "SELECT tipo, CAST(count(*) AS BIGINT) AS cantidad FROM (SELECT CASE WHEN contains(demographic, '@') THEN 'email' "
       "WHEN length(demographic) = 10 AND demographic LIKE '3%' THEN 'movil' WHEN length(demographic) = 10 AND demographic LIKE '6%' THEN 'fijo' "
       "ELSE 'errado' END AS tipo FROM lago) GROUP BY 1")
def kinds(t):
    return a.type_counts(t.lago.select(contacts.contact_type("demographic", cleaned=False).alias("tipo")), "tipo")


_SLOTS = ["celular1", "celular2", "celular3", "celular4", "fijo1", "fijo2"]


def _count_sql(low: int, high: int) -> str:
    return " + ".join(f"CASE WHEN TRY_CAST({c} AS BIGINT) BETWEEN {low} AND {high} THEN 1 ELSE 0 END" for c in _SLOTS)


@query(
    "a12_contact_counters",
    f"""
    SELECT orden, {_count_sql(3000000009, 3599999999)} AS num_movil, {_count_sql(6000000009, 6599999999)} AS num_fijo,
      CASE WHEN contains(coalesce(email1, ''), '@') THEN 1 ELSE 0 END + CASE WHEN contains(coalesce(email2, ''), '@') THEN 1 ELSE 0 END AS num_email,
      CASE WHEN {_count_sql(3000000009, 3599999999)} > 0 THEN 'SI TIENE' ELSE 'NO TIENE' END AS movil FROM base
    """,
)
def counters(t):
    counted = t.base.select(
        "orden",
        filled_slots(_SLOTS, lambda c: contacts.in_range(c, fixed.MOBILE_RANGE)).alias("num_movil"),
        filled_slots(_SLOTS, lambda c: contacts.in_range(c, fixed.COUNTED_LANDLINE_RANGE)).alias("num_fijo"),
        filled_slots(["email1", "email2"], lambda c: c.contains("@")).alias("num_email"),
    )
    return counted.withColumn("movil", F.when(F.col("num_movil") > 0, "SI TIENE").otherwise("NO TIENE"))



@query(
    "a13_agent_results",
    """
    SELECT dia AS "Día", canal AS "Tipologia Grupo", cuenta AS "Agente", n AS "Productividad", e AS "Efectividad", k AS "Tipologia" FROM (
      SELECT dia, canal, cuenta, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (estado = 'XFER') AS BIGINT) AS e, 'Recaudo' AS k
        FROM contactos WHERE canal IN ('click', 'view') GROUP BY 1, 2, 3
      UNION ALL SELECT dia, canal, cuenta, CAST(count(*) AS BIGINT), NULL, 'Cuentas' FROM contactos WHERE canal = 'error' GROUP BY 1, 2, 3)
    """,
)
def agents(t):
    rows = t.contactos.withColumnsRenamed({"dia": "Día", "canal": "Tipologia Grupo", "cuenta": "Agente"})
    keys = ["Día", "Tipologia Grupo", "Agente"]
    collected = rows.filter(F.col("Tipologia Grupo").isin("click", "view")).groupBy(*keys).agg(
        F.count("*").alias("Acuerdos"), F.count_if(F.col("estado") == "XFER").alias("Pagos")
    )
    services = rows.filter(F.col("Tipologia Grupo") == "error").groupBy(*keys).agg(
        F.count("*").alias("Servicios Gestionados")
    )
    return a.agent_results([collected, services])


@query(
    "w5_partition_count",
    "SELECT orden, identificacion, CAST(count(*) OVER (PARTITION BY identificacion) AS BIGINT) AS cuentas FROM base",
)
def partition_counts(t):
    return a.with_group_stats(t.base.select("orden", "identificacion"), ["identificacion"], cuentas=F.count("*"))


CALENDAR_SQL = """
    WITH p AS (SELECT DISTINCT clave, dia FROM presencia), g AS (SELECT clave, min(dia) AS primero, max(dia) AS ultimo FROM p GROUP BY 1),
    d AS (SELECT g.*, UNNEST(range(1, 32)) AS dia FROM g),
    e AS (SELECT d.*, CASE WHEN p.dia IS NOT NULL THEN 'Asignada' WHEN d.dia > primero AND d.dia < ultimo THEN 'Sin reasignar'
      WHEN d.dia = ultimo + 1 AND d.dia <= (SELECT max(dia) FROM p) THEN 'Retirada' ELSE '' END AS estado
      FROM d LEFT JOIN p ON p.clave = d.clave AND p.dia = d.dia)
"""


@query(
    "c1_calendar",
    CALENDAR_SQL + " SELECT clave, array_to_string(list(estado ORDER BY dia), ',') AS dias FROM e GROUP BY 1",
)
def calendars(t):
    return cal.calendar(t.presencia, "clave", "dia").select("clave", F.array_join("dias", ",").alias("dias"))


_SPAN = q.day_band("asignada + retirada")


@query(
    "c2_calendar_summary",
    CALENDAR_SQL + f"""
    SELECT clave, asignada AS dias_asignada, retirada AS dias_retirada, asignada + retirada AS rango_de_dias, primero || '/1/2024' AS fecha_ingreso,
      CASE WHEN salida IS NULL THEN '-' ELSE salida || '/1/2024' END AS fecha_retiro,
      CASE WHEN salida IS NULL THEN 'En gestion' ELSE 'Recuperada' END AS estado_cuenta, {_SPAN} AS grupo_rango_de_dias
    FROM (SELECT clave, CAST(count(*) FILTER (estado = 'Asignada') AS INT) AS asignada, CAST(count(*) FILTER (estado IN ('Retirada', 'Sin reasignar')) AS INT)
      AS retirada, min(dia) FILTER (estado = 'Asignada') AS primero, max(dia) FILTER (estado = 'Retirada') AS salida FROM e GROUP BY 1)
    """,
)
def calendar_summaries(t):
    summary = cal.calendar_summary(cal.calendar(t.presencia, "clave", "dia"), "1/2024")
    return summary.drop("dias", "primer_dia", "ultimo_dia")


@query(
    "s18_find_column",
    "SELECT tipo, CAST(count(*) AS BIGINT) AS filas FROM envios GROUP BY 1",
)
def grouping_column(t):
    rows = t.envios.select("remitente", "tipo", "valor")
    name = find_column(rows)
    return rows.groupBy(F.col(name).alias("tipo")).agg(F.count("*").alias("filas"))
