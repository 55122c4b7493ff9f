"""Projections, renames and predicates P1-P19 and K8 over the stand-in views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from dunlake.catalog import sqltext as q
from dunlake.catalog.registry import query
from dunlake.functions import amounts, bands, classes, contacts
from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import number
from dunlake.operators import joins
from dunlake.operators import projection as p
from dunlake.operators.dedup import dedup
from dunlake.operators.search import search, search_summary

FLAG_SQL = f"""
    WITH validos AS (SELECT DISTINCT ON (cuenta, dato) * FROM (SELECT cuenta, marca, Mod_init_cta, orden,
      UNNEST([celular1, celular2, celular3, celular4, fijo1, fijo2]) AS dato FROM base) WHERE {q.valid_phone('dato')})
    SELECT marca, {q.debt_band('Mod_init_cta')} AS rango, CAST(count(*) AS BIGINT) AS contactos,
      CAST(sum(coalesce(TRY_CAST(Mod_init_cta AS DECIMAL(18,2)), 0)) AS DOUBLE) AS deuda FROM validos GROUP BY 1, 2
"""


@query("flagship_debt_by_brand_and_band", FLAG_SQL)
def flagship(t):
    """Valid, deduplicated contacts of each account, by brand and debt band."""
    slots = F.array("celular1", "celular2", "celular3", "celular4", "fijo1", "fijo2")
    rows = t.base.select("cuenta", "marca", "Mod_init_cta", "orden", F.explode(slots).alias("dato"))
    valid = dedup(rows.filter(contacts.contact_filter("dato")), ["cuenta", "dato"], ["orden"])
    amount = F.coalesce(F.col("Mod_init_cta").try_cast("decimal(18,2)"), F.lit(0))
    return valid.groupBy("marca", bands.debt_band("Mod_init_cta").alias("rango")).agg(
        F.count("*").alias("contactos"), F.sum(amount).cast("double").alias("deuda")
    )


@query(
    "p1_rename",
    "SELECT cuenta2 AS CUENTA_NEXT, marca AS Edad_Mora, origen AS CRM, Mod_init_cta AS Saldo_Asignado FROM base",
)
def renamed(t):
    names = {"cuenta2": "CUENTA_NEXT", "marca": "Edad_Mora", "origen": "CRM", "Mod_init_cta": "Saldo_Asignado"}
    return p.rename(t.base, names, only_mapped=True)


@query(
    "p2_prefix_groups",
    'SELECT cuenta AS "BG_cuenta", marca AS "BG_marca", plan AS "DS_VAR_tipo_plan", celular1 AS "FLT_celular1" FROM base',
)
def prefixed(t):
    rows = t.base.withColumnRenamed("plan", "TIPO PLAN")
    groups = {"BG_": ["cuenta", "marca", "ausente"], "DS_VAR_": ["TIPO PLAN"], "FLT_": ["celular1", "celular99"]}
    return p.prefix_groups(rows, groups)


@query(
    "p3_map_schema",
    """
    SELECT identificacion AS "Identificacion", replace(cuenta, '-', '') AS "Cuenta_Next", marca AS "marca2", marca AS "Edad_Mora",
      replace(Mod_init_cta, '.', ',') AS "Saldo_Asignado", 'Desconocida' AS "fechapromesa", '10' AS "Hora_Envio",
      CAST(NULL AS VARCHAR) AS "SMS" FROM base
    """,
)
def mapped_schema(t):
    target = ["Identificacion", "Cuenta_Next", "marca2", "Edad_Mora", "Saldo_Asignado", "fechapromesa", "Hora_Envio", "SMS"]
    return p.map_schema(
        t.base,
        target,
        mapping={"Identificacion": "identificacion", "marca2": "marca", "SMS": "OUTPUT_DATA"},
        literals={"fechapromesa": "Desconocida"},
        derived={
            "Cuenta_Next": F.translate("cuenta", "-", ""),
            "Edad_Mora": F.col("marca"),
            "Saldo_Asignado": amounts.decimal_comma("Mod_init_cta"),
            "Hora_Envio": F.substring(F.lit("10:30"), 1, 2),
        },
    )


@query(
    "p4_filter_members",
    "SELECT orden, marca, origen FROM base WHERE marca IN ('0', '30', 'potencial') AND origen IN ('RR', 'BSCS')",
)
def members(t):
    return p.filter_members(t.base, {"marca": ["0", "30", "potencial"], "origen": ["RR", "BSCS"]}).select(
        "orden", "marca", "origen"
    )


@query(
    "p5_filter_groups",
    f"""
    SELECT orden, marca FROM base WHERE lower(marca) IN {q.in_list(fixed.BRAND_GROUPS['0 - 30'] + fixed.BRAND_GROUPS['Especiales'])}
      OR lower(marca) IN ('potencial a castigar', 'prepotencial especial')
    """,
)
def group_members(t):
    dimension = joins.brand_dimension(t.spark)
    return joins.filter_groups(t.base, "marca", ["0 - 30", "Especiales"], dimension).select("orden", "marca")


@query(
    "p6_open_payments",
    """
    SELECT orden, tipo_pago, coalesce(tipo_pago, '') IN ('', 'Sin Pago') AS para_ivr FROM base
    WHERE tipo_pago IS NULL OR tipo_pago IN ('', 'Pago Parcial', 'Sin Pago')
    """,
)
def open_payments(t):
    rows = t.base.filter(p.is_open_payment("tipo_pago"))
    return rows.select("orden", "tipo_pago", p.is_open_payment("tipo_pago", allow_partial=False).alias("para_ivr"))


@query(
    "p7_due_on",
    "SELECT coalesce(fecha_vencimiento = '19/06/1995', false) AS vence, CAST(count(*) AS BIGINT) AS filas FROM base GROUP BY 1",
)
def due_on(t):
    due = F.coalesce(p.is_due_on("fecha_vencimiento", "19/06/1995"), F.lit(False))
    rows = t.base.filter(p.is_due_on("fecha_vencimiento", None))
    return rows.groupBy(due.alias("vence")).agg(F.count("*").alias("filas"))


@query(
    "p8_amount_between",
    "SELECT orden, Mod_init_cta FROM base WHERE TRY_CAST(Mod_init_cta AS DOUBLE) BETWEEN 20000 AND 500000",
)
def amounts_between(t):
    return t.base.filter(p.amount_between("Mod_init_cta", 20_000, 500_000)).select("orden", "Mod_init_cta")


@query(
    "p9_discount_class",
    f"SELECT orden, descuento, {q.discount_class('descuento')} AS clase FROM base WHERE {q.discount_class('descuento')} = 'Con Descuento'",
)
def discount_classes(t):
    rows = t.base.filter(p.has_benefit("descuento", "Con Descuento"))
    return rows.select("orden", "descuento", amounts.discount_class("descuento").alias("clase"))


@query(
    "p10_not_contacted",
    """
    SELECT orden, fechagestion_contactodirecto FROM base WHERE CASE WHEN fechagestion_contactodirecto IS NULL OR
      fechagestion_contactodirecto = '' THEN '2000-04-30' ELSE fechagestion_contactodirecto END <> '1998-01-01'
    """,
)
def not_contacted(t):
    kept = t.base.filter(p.not_contacted_on("fechagestion_contactodirecto", date(1998, 1, 1)))
    return kept.select("orden", "fechagestion_contactodirecto")


@query(
    "p11_exclude_profiles",
    f"""
    SELECT orden, mejorperfil, ultimoperfil FROM base WHERE mejorperfil NOT IN {q.in_list(fixed.BAD_PROFILES)}
      AND ultimoperfil NOT IN {q.in_list(fixed.BAD_PROFILES)}
    """,
)
def good_profiles(t):
    return p.exclude_profiles(t.base, ["mejorperfil", "ultimoperfil"]).select("orden", "mejorperfil", "ultimoperfil")


@query(
    "p12_all_profiles_equal",
    """
    SELECT DISTINCT replace(cuenta, '-', '') AS "CUENTA", '2001-06-15' AS "FECHA" FROM base
    WHERE mejorperfil = 'Reclamacion' AND ultimoperfil = 'Reclamacion' AND perfil_historico = 'Reclamacion'
    """,
)
def complaints(t):
    profiles = ["mejorperfil", "ultimoperfil", "perfil_historico"]
    return p.all_profiles_equal(t.base, "cuenta", profiles, fixed.COMPLAINT_PROFILE, date(2001, 6, 15))


@query("p13_without_text", "SELECT orden, ciudad FROM base WHERE NOT contains(ciudad, 'MANUAL')")
def without_manual(t):
    return p.without_text(t.base, "ciudad", "MANUAL").select("orden", "ciudad")


_VALID = "coalesce(TRY_CAST(customer_type_id AS INT) BETWEEN 80 AND 89, false) AND referencia IS NOT NULL AND ciudad IS NOT NULL"


@query(
    "p14_split_valid",
    f"""
    SELECT 'buenas' AS salida, customer_type_id, CAST(count(*) AS BIGINT) AS filas FROM base WHERE {_VALID} GROUP BY 2
    UNION ALL SELECT 'errores', customer_type_id, CAST(count(*) AS BIGINT) FROM base WHERE NOT ({_VALID}) GROUP BY 2
    """,
)
def valid_split(t):
    good, errors = p.split_valid(t.base, "customer_type_id", ["referencia", "ciudad"])
    parts = good.withColumn("salida", F.lit("buenas")).unionByName(errors.withColumn("salida", F.lit("errores")))
    return parts.groupBy("salida", "customer_type_id").agg(F.count("*").alias("filas"))


TERMS = ("ing ", "tion", "eau", "@", "http", "no aparece nunca")
_TERM_LIST = "[" + ", ".join(q.quote(term) for term in TERMS) + "]"
_HITS = f"""
    SELECT doc_id, lang, source, termino AS "Dato_Buscado" FROM documents, (SELECT UNNEST({_TERM_LIST}) AS termino)
    WHERE contains(text, termino) OR contains(lang, termino) OR contains(source, termino)
"""


@query("p15_search", _HITS)
def found_terms(t):
    return search(t.documents, TERMS, ["text", "lang", "source"]).drop("text", "n_chars")


@query(
    "p15_search_summary",
    f"""
    WITH hits AS ({_HITS}), grupos AS (SELECT "Dato_Buscado", count(*) AS n, count(DISTINCT source) AS f FROM hits GROUP BY 1)
    SELECT termino AS "Dato_Buscado", CASE WHEN n > 0 THEN 'SI' ELSE 'NO' END AS "Encontrado", CAST(coalesce(n, 0) AS BIGINT)
      AS "Total_Coincidencias", CASE WHEN n > 0 THEN 'ENCONTRADO' ELSE 'NO_ENCONTRADO' END AS "Estado",
      CAST(coalesce(f, 0) AS BIGINT) AS "Archivos_Con_Coincidencias"
    FROM (SELECT UNNEST({_TERM_LIST}) AS termino) LEFT JOIN grupos ON termino = "Dato_Buscado"
    """,
)
def found_summary(t):
    return search_summary(search(t.documents, TERMS, ["text", "lang", "source"]), TERMS, file="source")


@query(
    "p16_dispatch_flag",
    """
    SELECT orden, CASE WHEN length(nombrecompleto) < 4 OR canal = 'DELIMITAR' OR filtro = 'SIN REFERENCIA' THEN 'Ajustar antes de envio'
      ELSE 'Limpio para envio' END AS filtro_general FROM (SELECT orden, nombrecompleto, CASE WHEN orden % 3 = 0 THEN 'DELIMITAR'
      ELSE 'EMAIL' END AS canal, CASE WHEN referencia <> '' THEN 'Con referencia' ELSE 'SIN REFERENCIA' END AS filtro FROM base)
    """,
)
def dispatch_flags(t):
    channel = F.when(F.col("orden") % 3 == 0, "DELIMITAR").otherwise("EMAIL")
    reference = F.when(F.col("referencia") != "", "Con referencia").otherwise("SIN REFERENCIA")
    flag = classes.dispatch_flag("nombrecompleto", channel, reference)
    return t.base.select("orden", flag.alias("filtro_general"))


@query(
    "p17_from_month",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS fecha FROM orders WHERE o_orderdate >= DATE '2001-06-01'",
)
def from_month(t):
    kept = p.from_month(t.orders, "o_orderdate", date(2001, 6, 15))
    return kept.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("fecha"))


@query(
    "p18_constants",
    "SELECT orden, 'pesos' AS currency, '' AS telefono_2, '2001-06-15' AS fecha_hoy FROM base",
)
def constants(t):
    values = {"currency": "pesos", "telefono_2": "", "fecha_hoy": date(2001, 6, 15).isoformat()}
    return p.with_constants(t.base.select("orden"), values)


@query("p19_drop_header_rows", "SELECT orden, plan FROM base WHERE plan <> 'B'")
def headerless(t):
    titled = t.base.select("orden", F.when(F.col("plan") == "B", "Plan Titulo").otherwise(F.col("plan")).alias("plan"))
    return p.drop_header_rows(titled, "plan", "Plan Titulo")


@query(
    "k8_route",
    """
    SELECT ruta, origen, CAST(count(*) AS BIGINT) AS filas FROM (
      SELECT 'todo' AS ruta, origen FROM base UNION ALL SELECT 'sin_castigo', origen FROM base WHERE marca <> 'castigo'
      UNION ALL SELECT 'grandes', origen FROM base WHERE TRY_CAST(Mod_init_cta AS DOUBLE) > 1000000) GROUP BY ALL
    """,
)
def routes(t):
    labelled = p.routed(
        t.base,
        {
            "todo": F.lit(True),
            "sin_castigo": F.col("marca") != "castigo",
            "grandes": number("Mod_init_cta") > 1_000_000,
        },
    )
    return labelled.groupBy("ruta", "origen").agg(F.count("*").alias("filas"))
