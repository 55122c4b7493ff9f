"""Domain classifications E1-E26 over the stand-in views."""

from __future__ import annotations

from pyspark.sql import functions as F

from dunlake.catalog import sqltext as q
from dunlake.catalog.registry import query
from dunlake.functions import amounts, bands, classes, contacts
from dunlake.functions import fixed_values as fixed
from dunlake.operators.regions import map_region


@query(
    "e1_debt_band",
    f"SELECT orden, Mod_init_cta AS deuda, {q.debt_band('Mod_init_cta')} AS rango, "
    f"CASE WHEN TRY_CAST(Mod_init_cta AS DOUBLE) * (CASE WHEN orden % 3 = 0 THEN 0 ELSE 1 END) = 0 THEN '0 No Aplica' "
    f"ELSE {q.debt_band('(TRY_CAST(Mod_init_cta AS DOUBLE) * (CASE WHEN orden % 3 = 0 THEN 0 ELSE 1 END))')} END AS rango_descuento "
    "FROM base",
)
def debt_bands(t):
    reduced = F.col("Mod_init_cta").try_cast("double") * F.when(F.col("orden") % 3 == 0, 0).otherwise(1)
    return t.base.select(
        "orden",
        F.col("Mod_init_cta").alias("deuda"),
        bands.debt_band("Mod_init_cta").alias("rango"),
        bands.discount_band(reduced).alias("rango_descuento"),
    )


_SLOTS = "UNNEST([celular1, celular4, fijo1, fijo2, email1])"


@query(
    "e2_contact_filter",
    f"SELECT dato, coalesce({q.mobile('dato')}, false) AS movil, "
    "coalesce(TRY_CAST(dato AS BIGINT) BETWEEN 6010000009 AND 6089999999, false) AS fijo, "
    f"coalesce({q.valid_phone('dato')}, false) AS telefono, contains(dato, '@') AS correo, CAST(count(*) AS BIGINT) AS filas "
    f"FROM (SELECT {_SLOTS} AS dato FROM base) WHERE dato IS NOT NULL GROUP BY ALL",
)
def contact_filters(t):
    slots = t.base.select(F.explode(F.array("celular1", "celular4", "fijo1", "fijo2", "email1")).alias("dato"))

    def flag(kind):
        return F.coalesce(contacts.contact_filter("dato", kind), F.lit(False))

    return slots.filter("dato IS NOT NULL").groupBy("dato").agg(F.count("*").alias("filas")).select(
        "dato",
        flag("mobile").alias("movil"),
        flag("landline").alias("fijo"),
        flag("both").alias("telefono"),
        flag("email").alias("correo"),
        "filas",
    )


@query(
    "e3_contact_type",
    """
    SELECT account, demographic, limpio, CASE WHEN contains(demographic, '@') THEN 'email'
      WHEN length(limpio) = 10 AND limpio LIKE '3%' THEN 'movil' WHEN length(limpio) = 10 AND limpio LIKE '6%' THEN 'fijo'
      ELSE 'errado' END AS tipo,
      CASE WHEN length(demographic) = 10 AND demographic LIKE '6%' THEN 'fijo' WHEN length(demographic) = 10 AND demographic LIKE '3%'
      THEN 'movil' WHEN contains(demographic, '@') THEN 'email' ELSE 'errado' END AS tipo_sin_limpiar
    FROM (SELECT account, demographic, CASE WHEN contains(demographic, '@') THEN demographic
      ELSE regexp_replace(regexp_replace(demographic, '[^0-9]', '', 'g'), '^0+', '') END AS limpio FROM lago)
    """,
)
def contact_types(t):
    return t.lago.select(
        "account",
        "demographic",
        contacts.clean_contact("demographic").alias("limpio"),
        contacts.contact_type("demographic").alias("tipo"),
        contacts.contact_type("demographic", cleaned=False).alias("tipo_sin_limpiar"),
    )


_AREA = "CASE " + " ".join(
    f"WHEN lugar IN {q.in_list(places)} THEN '{digit}'" for digit, places in fixed.AREA_BY_PLACE.items()
) + " END"


@query(
    "e4_rebuild_landline",
    f"""
    WITH numeros AS (SELECT orden, ciudad, substr(fijo1, 1, CAST(7 + orden % 3 AS INT)) AS numero FROM base),
    lugares AS (SELECT *, split_part(regexp_replace(split_part(CASE WHEN ciudad IS NULL OR ciudad = '' THEN 'BOGOTA' ELSE ciudad END,
      '/', 1), '[^A-Z ]', '', 'g'), ' ', 1) AS lugar FROM numeros),
    armados AS (SELECT *, CASE length(numero) WHEN 7 THEN '60' || {_AREA} || numero WHEN 8 THEN '60' || numero END AS armado,
      {_AREA} AS area FROM lugares)
    SELECT orden, ciudad, numero, CASE WHEN (TRY_CAST(numero AS BIGINT) <= 3000000000 OR TRY_CAST(numero AS BIGINT)
      BETWEEN 3599999999 AND 6010000000) AND area IS NOT NULL AND (TRY_CAST(armado AS BIGINT) BETWEEN 3000000001 AND 3599999998
      OR TRY_CAST(armado AS BIGINT) BETWEEN 6010000000 AND 6089999998) THEN armado END AS fijo FROM armados
    """,
)
def rebuilt_landlines(t):
    number = F.substring(F.col("fijo1"), F.lit(1), (F.lit(7) + F.col("orden") % 3).cast("int"))
    return t.base.select(
        "orden", "ciudad", number.alias("numero"), contacts.rebuild_landline(number, "ciudad").alias("fijo")
    )


@query(
    "e5_landline_from_pair",
    """
    WITH pares AS (SELECT orden, CASE orden % 5 WHEN 0 THEN '1' WHEN 1 THEN '601.0' WHEN 2 THEN '4' WHEN 3 THEN '' END AS area,
      substr(fijo2, 1, CAST(7 + orden % 4 AS INT)) AS numero FROM base)
    SELECT orden, area, numero, CASE length(numero) WHEN 10 THEN numero WHEN 8 THEN '60' || numero WHEN 7 THEN
      CASE WHEN area IN ('1', '601.0', '') THEN '601' || numero WHEN area = '4' THEN '604' || numero END END AS fijo FROM pares
    """,
)
def landline_pairs(t):
    area = (
        F.when(F.col("orden") % 5 == 0, "1").when(F.col("orden") % 5 == 1, "601.0")
        .when(F.col("orden") % 5 == 2, "4").when(F.col("orden") % 5 == 3, "")
    )
    number = F.substring(F.col("fijo2"), F.lit(1), (F.lit(7) + F.col("orden") % 4).cast("int"))
    pairs = t.base.select("orden", area.alias("area"), number.alias("numero"))
    return pairs.withColumn("fijo", contacts.landline_from_pair("area", "numero"))


@query(
    "e6_assign_brand",
    f"SELECT orden, {q.assign_brand('origen', 'marca5', 'marca6', 'marca7', 'refinanciada', 'edad', 'nombre_campana')} AS con_especial, "
    f"{q.assign_brand('origen', 'marca5', 'marca6', 'marca7', 'refinanciada', 'edad').replace(chr(39) + 'RR' + chr(39) + ',' + chr(39) + 'SGA' + chr(39), chr(39) + 'RR' + chr(39))} AS solo_rr "
    "FROM base",
)
def brands(t):
    marks = ("origen", "marca5", "marca6", "marca7", "refinanciada", "edad")
    return t.base.select(
        "orden",
        classes.assign_brand(*marks, campaign="nombre_campana").alias("con_especial"),
        classes.assign_brand(*marks, box_origins=("RR",)).alias("solo_rr"),
    )


@query(
    "e7_segment",
    "SELECT orden, CASE WHEN customer_type_id IN ('81','84','87') THEN 'Personas' ELSE 'Negocios' END AS segmento FROM base",
)
def segments(t):
    return t.base.select("orden", classes.segment("customer_type_id").alias("segmento"))


@query("e8_document_type", f"SELECT orden, documento, {q.document_type('documento')} AS tipo FROM base")
def document_types(t):
    return t.base.select("orden", "documento", classes.document_type("documento").alias("tipo"))


@query("e9_base_type", f"SELECT orden, {q.base_type('nombre_campana')} AS tipo_base FROM base")
def base_types(t):
    return t.base.select("orden", classes.base_type("nombre_campana").alias("tipo_base"))


@query(
    "e10_keyword_group",
    f"""
    SELECT campana, grupo, {q.unified_group('grupo', "WHEN contains(lower(grupo), 'otra') AND canal = 'view' THEN 'PROPIA'")} AS unido,
      CAST(count(*) AS BIGINT) AS filas FROM (SELECT campana, canal, {q.keyword_group('campana')} AS grupo FROM envios) GROUP BY ALL
    """,
)
def keyword_groups(t):
    grouped = t.envios.select("campana", "canal", classes.keyword_group("campana").alias("grupo"))
    unified = classes.unified_group(
        "grupo", own_name="otra", own_source=F.col("canal") == "view", own_group="PROPIA"
    )
    return grouped.groupBy("campana", "grupo", unified.alias("unido")).agg(F.count("*").alias("filas"))


_RULES = """
    SELECT n_nationkey AS prioridad, n_name AS pueblo, r_name AS departamento FROM nation JOIN region ON n_regionkey = r_regionkey
"""


@query(
    "e11_map_region",
    f"""
    WITH reglas AS ({_RULES}),
    lugares AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'VACIO' WHEN s_suppkey % 13 = 0 THEN 'LEJOS'
      ELSE upper(split_part(n_name || '5 CENTRO/X', '/', 1)) END AS lugar FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    primeras AS (SELECT lugar, min_by(departamento, prioridad) AS departamento FROM (SELECT DISTINCT lugar FROM lugares)
      JOIN reglas ON contains(lugar, pueblo) GROUP BY lugar)
    SELECT s_suppkey, CASE WHEN lugar = 'VACIO' THEN 'VACIO' ELSE coalesce(departamento, 'NO IDENTIFICADO') END AS DEPARTAMENTO
    FROM lugares LEFT JOIN primeras USING (lugar)
    """,
)
def regions(t):
    rules = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("prioridad"), F.col("n_name").alias("pueblo"), F.col("r_name").alias("departamento")
    )
    place = (
        F.when(F.col("s_suppkey") % 11 == 0, F.lit(None))
        .when(F.col("s_suppkey") % 13 == 0, F.lit("lejos"))
        .otherwise(F.concat("n_name", F.lit("5 Centro/X")))
    )
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", place.alias("ciudad")
    )
    return map_region(suppliers, "ciudad", rules, departments=None).drop("ciudad")


_GROUPS = q.case_map("replace(lower(perfil), ' ', '')", fixed.PROFILE_GROUPS, "NULL")


@query("e12_profile_group", f"SELECT evento, perfil, {_GROUPS} AS grupo FROM contactos")
def profile_groups(t):
    return t.contactos.select("evento", "perfil", classes.profile_group("perfil").alias("grupo"))


@query(
    "e13_mix_label",
    """
    SELECT cuenta, d, i, n, CASE WHEN d > 0 AND i > 0 AND n > 0 THEN 'CDIR CIND NOC' WHEN d > 0 AND i > 0 THEN 'CDIR CIND'
      WHEN d > 0 AND n > 0 THEN 'CDIR NOC' WHEN i > 0 AND n > 0 THEN 'CIND NOC' WHEN d > 0 THEN 'CDIR' WHEN i > 0 THEN 'CIND'
      WHEN n > 0 THEN 'NOC' ELSE '' END AS mezcla
    FROM (SELECT orden AS cuenta, orden % 2 AS d, orden % 3 AS i, orden % 5 AS n FROM base)
    """,
)
def mix_labels(t):
    parts = t.base.selectExpr("orden AS cuenta", "orden % 2 AS d", "orden % 3 AS i", "orden % 5 AS n")
    return parts.withColumn("mezcla", classes.mix_label("d", "i", "n"))


@query(
    "e14_contact_profile",
    """
    SELECT cuenta, CASE WHEN m > 0 AND f > 0 AND e > 0 THEN 'Celular Fijo Email' WHEN m > 0 AND f > 0 THEN 'Celular Fijo'
      WHEN m > 0 AND e > 0 THEN 'Celular Email' WHEN m > 0 THEN 'Celular' WHEN f > 0 AND e > 0 THEN 'Fijo Email'
      WHEN f > 0 THEN 'Fijo' WHEN e > 0 THEN 'Email' ELSE 'No posee Demograficos' END AS perfil,
      CASE WHEN coalesce(m, 0) = 0 THEN '' ELSE CAST(m AS VARCHAR) END AS moviles
    FROM (SELECT orden AS cuenta, CASE WHEN orden % 7 = 0 THEN NULL ELSE orden % 2 END AS m, orden % 3 AS f, orden % 5 AS e FROM base)
    """,
)
def contact_profiles(t):
    parts = t.base.selectExpr(
        "orden AS cuenta", "CASE WHEN orden % 7 = 0 THEN NULL ELSE orden % 2 END AS m", "orden % 3 AS f", "orden % 5 AS e"
    )
    return parts.select(
        "cuenta", classes.contact_profile("m", "f", "e").alias("perfil"), classes.shown_count("m").alias("moviles")
    )


_OVERDUE = q.day_band(
    "mora", (fixed.NOT_YET_DUE_BAND, *fixed.DAY_BANDS, fixed.LONG_OVERDUE_BAND),
    "CASE WHEN mora IS NULL THEN 'Nulo' ELSE 'Fuera de rango' END",
)


@query(
    "e15_day_bands",
    f"""
    SELECT orden, mora, {q.day_band('mora')} AS rango_dias, {_OVERDUE} AS rango_mora
    FROM (SELECT orden, CASE WHEN orden % 19 = 0 THEN NULL ELSE orden % 160 - 40 END AS mora FROM base)
    """,
)
def day_bands(t):
    days = t.base.selectExpr("orden", "CASE WHEN orden % 19 = 0 THEN NULL ELSE orden % 160 - 40 END AS mora")
    return days.select(
        "orden", "mora", bands.day_band("mora").alias("rango_dias"), bands.overdue_band("mora").alias("rango_mora")
    )


@query(
    "e16_dialer_outcome",
    f"""
    SELECT evento, estado, {q.case_map('estado', fixed.DIALER_TEXT, "'error'")} AS texto,
      {q.case_map('estado', fixed.DIALER_PROFILE, "'error'")} AS perfil_llamada,
      CASE WHEN length(cuenta_real) < 3 THEN 'Sin cuenta' WHEN estado IN {q.in_list(fixed.DIALER_INEFFECTIVE)} THEN 'No efectivo'
      WHEN estado = 'NEW' THEN 'Sin marcar' ELSE 'Efectivo' END AS efecto FROM contactos
    """,
)
def dialer_outcomes(t):
    return t.contactos.select(
        "evento",
        "estado",
        classes.dialer_text("estado").alias("texto"),
        classes.dialer_profile("estado").alias("perfil_llamada"),
        classes.dialer_effect("estado", "cuenta_real").alias("efecto"),
    )


BOT_SQL = """
    SELECT evento, principal, CASE WHEN previa = 'TITULAR' AND principal = 'Cliente al dia' THEN 'YA PAGO'
      WHEN previa = 'TITULAR' AND principal = 'Compromiso de Pago con BOT' THEN 'PROMESA' ELSE previa END AS tipologia FROM (
    SELECT evento, CASE WHEN pago IN ('confirmacion_pago', 'propuesta_pago_valida') THEN 'Compromiso de Pago con BOT'
      WHEN pago = 'ya_pago' THEN 'Cliente al dia' WHEN disposicion = 'ANSWER' THEN 'Efectivo sin Compromiso de Pago'
      ELSE 'No efectivo' END AS principal,
      CASE WHEN disposicion = 'INVALID' THEN 'INVALIDO' WHEN disposicion = 'BUSY' THEN 'OCUPADO'
      WHEN pago IN ('respuesta_invalida', 'negacion_pago') THEN 'RENUENTE'
      WHEN disposicion = 'ANSWER' AND identidad = 'confirmar_identidad' THEN 'TITULAR'
      WHEN disposicion = 'ANSWER' AND identidad = 'negar_identidad' THEN 'EQUIVOCADO'
      WHEN disposicion = 'ANSWER' AND identidad IN ('familiar_conocido', 'no_disponible') THEN 'TERCERO'
      WHEN disposicion = 'ANSWER' AND identidad IN ('repetir_pregunta', 'respuesta_invalida') THEN 'SIN CONFIRMAR TITULARIDAD'
      WHEN disposicion = 'ANSWER' AND identidad IS NULL THEN 'CONTESTADO' WHEN disposicion = 'NO RING' THEN 'NO TIMBRA'
      WHEN disposicion = 'NO ANSWER' THEN 'NO RESPONDIDO' WHEN disposicion = 'VOICEMAIL' THEN 'BUZON DE VOZ'
      ELSE 'NO MARCADO' END AS previa FROM contactos)
"""


@query("e17_bot_outcome", BOT_SQL)
def bot_outcomes(t):
    return t.contactos.select(
        "evento",
        classes.bot_main_filter("disposicion", "pago").alias("principal"),
        classes.bot_typology("disposicion", "identidad", "pago").alias("tipologia"),
    )


_STATES = "CASE orden % 9 WHEN 0 THEN 'no' WHEN 1 THEN 'Si' WHEN 2 THEN 'ajuste' WHEN 3 THEN 'pendiente' WHEN 4 THEN 'Pago Total No_Rx' WHEN 5 THEN 'x gestión recaudo' WHEN 6 THEN 'gestion_recaudo' WHEN 7 THEN 'otro' END"


@query(
    "e18_ranking_state",
    f"""
    SELECT orden, llave, CASE WHEN llave IN ('NOFIJA') THEN 'NO RECUPERADA' WHEN llave = 'SIFIJA' THEN 'RECUPERADA'
      WHEN llave IN ('NOMOVIL', 'PAGO TOTAL NO RXMOVIL', 'PAGO TOTAL NO_RXMOVIL', 'PAGO TOTAL NO-RX', 'PAGO TOTAL SI RXMOVIL',
      'PAGO TOTAL SI_RXMOVIL', 'PAGO TOTAL SI-RX') THEN 'NO GESTIONAR' WHEN llave IN ('AJUSTEMOVIL', 'PENDIENTEMOVIL', 'SIMOVIL')
      THEN 'GESTIONAR' WHEN contains(llave, 'GESTION RECAUDO') OR contains(llave, 'GESTION_RECAUDO') OR
      contains(llave, 'GESTIÓN_RECAUDO') OR contains(llave, 'GESTIÓN RECAUDO') THEN 'GESTION RECAUDO' ELSE llave END AS estado
    FROM (SELECT orden, upper({_STATES} || CASE WHEN orden % 2 = 0 THEN 'movil' ELSE 'fija' END) AS llave FROM base)
    """,
)
def ranking_states(t):
    rows = t.base.selectExpr("orden", f"{_STATES} AS e", "CASE WHEN orden % 2 = 0 THEN 'movil' ELSE 'fija' END AS k")
    return rows.select("orden", F.upper(F.concat("e", "k")).alias("llave"), classes.ranking_state("e", "k").alias("estado"))


@query(
    "e19_origin_label",
    f"""
    SELECT orden, origen, {q.case_map('origen', fixed.ORIGIN_LABELS['sms'], 'origen')} AS sms,
      {q.case_map('origen', fixed.ORIGIN_LABELS['bot'], 'origen')} AS bot,
      {q.case_map('origen', fixed.ORIGIN_LABELS['email'], 'origen')} AS email,
      CASE WHEN origen = 'ASCARD' THEN 'bloqueo' ELSE 'suspension' END AS estado,
      {q.case_map('origen', fixed.BOX_CODES, "'Error'")} AS caja FROM (SELECT orden, CASE WHEN orden % 10 = 0 THEN 'OTRO' ELSE origen END AS origen FROM base)
    """,
)
def origin_labels(t):
    rows = t.base.selectExpr("orden", "CASE WHEN orden % 10 = 0 THEN 'OTRO' ELSE origen END AS origen")
    return rows.select(
        "orden",
        "origen",
        *[classes.origin_label("origen", kind).alias(kind) for kind in ("sms", "bot", "email")],
        classes.origin_state("origen").alias("estado"),
        classes.box_code("origen").alias("caja"),
    )


_BAD = " OR ".join(f"contains(lower(correo), {q.quote(part)})" for part in fixed.BAD_EMAIL_PARTS)
EMAIL_QUALITY = f"""CASE WHEN {_BAD} THEN 'ERRADO' WHEN length(split_part(correo, '@', 1)) < 6 THEN 'ERRADO'
      WHEN length(str_split(correo, '@')) = 2 THEN 'CORREO UNICO' WHEN length(str_split(correo, '@')) >= 3 THEN 'CORREOS SIN DELIMITAR'
      ELSE 'ERRADO' END"""


@query(
    "e20_email_quality",
    f"SELECT orden, correo, {EMAIL_QUALITY} AS calidad FROM (SELECT orden, UNNEST([email1, email2]) AS correo FROM base)",
)
def email_qualities(t):
    rows = t.base.select("orden", F.explode(F.array("email1", "email2")).alias("correo"))
    return rows.withColumn("calidad", contacts.email_quality("correo"))


@query(
    "e20_email_quality_of_texts",
    """
    SELECT doc_id, correo, """ + EMAIL_QUALITY + r""" AS calidad FROM (SELECT doc_id,
      UNNEST(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS correo FROM documents)
    """,
)
def text_emails(t):
    pattern = F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")
    found = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("correo"))
    return found.withColumn("calidad", contacts.email_quality("correo"))


@query(
    "e21_clean_email",
    f"""
    SELECT orden, correo, {q.clean_email('correo')} AS limpio,
      CASE WHEN length(correo) - length(replace(correo, '@', '')) = 1 THEN 'EMAIL' ELSE 'DELIMITAR' END AS canal
    FROM (SELECT orden, UNNEST([email1, email2]) AS correo FROM base)
    """,
)
def clean_emails(t):
    rows = t.base.select("orden", F.explode(F.array("email1", "email2")).alias("correo"))
    return rows.select(
        "orden", "correo", contacts.clean_email("correo").alias("limpio"), contacts.email_channel("correo").alias("canal")
    )


@query(
    "e22_base_defaults",
    f"""
    SELECT orden, {q.plain_discount('descuento')} AS dcto, CASE WHEN tipo_pago IS NULL OR tipo_pago = '' THEN 'Sin Pago'
      ELSE tipo_pago END AS pago, CASE WHEN estado_ranking IS NULL OR estado_ranking = '' THEN 'NO APLICA FILTRO RANKING'
      ELSE estado_ranking END AS ranking, CASE WHEN ciudad = 'ASIGNACION_MANUAL_APPLE' THEN 'Apple Manual' ELSE marca END AS marca2
    FROM base
    """,
)
def base_defaults(t):
    return t.base.select(
        "orden",
        amounts.plain_discount("descuento").alias("dcto"),
        classes.known_payment("tipo_pago").alias("pago"),
        classes.known_ranking("estado_ranking").alias("ranking"),
        classes.second_brand("ciudad", "marca").alias("marca2"),
    )


@query(
    "e23_flags",
    """
    SELECT orden, CASE WHEN n >= 1 THEN 'Aplica' ELSE '' END AS filtro_pagos,
      CASE WHEN TRY_CAST(replace(descuento, '%', '') AS DOUBLE) = 0 THEN 'No Aplica' ELSE 'Aplica' END AS filtro_descuento
    FROM (SELECT orden, descuento, CASE WHEN orden % 4 = 0 THEN NULL ELSE orden % 3 END AS n FROM base)
    """,
)
def flags(t):
    rows = t.base.selectExpr("orden", "descuento", "CASE WHEN orden % 4 = 0 THEN NULL ELSE orden % 3 END AS n")
    return rows.select(
        "orden",
        amounts.counted_flag("n").alias("filtro_pagos"),
        amounts.discount_flag("descuento").alias("filtro_descuento"),
    )


@query(
    "e24_line_type",
    "SELECT orden, dato, CASE WHEN TRY_CAST(dato AS BIGINT) < 6000000000 THEN 'Celular' ELSE 'Fijo' END AS linea "
    "FROM (SELECT orden, UNNEST([celular1, celular4, fijo1]) AS dato FROM base)",
)
def line_types(t):
    rows = t.base.select("orden", F.explode(F.array("celular1", "celular4", "fijo1")).alias("dato"))
    return rows.withColumn("linea", contacts.line_type("dato"))


@query(
    "e25_fix_marks",
    "SELECT orden, CASE WHEN refinanciada = 'Y' AND (marca5 = 'Y' OR marca6 = 'Y' OR marca7 = 'Y') THEN '' ELSE refinanciada END "
    "AS refinanciada FROM base",
)
def fixed_marks(t):
    mark = classes.refinance_mark("refinanciada", "marca5", "marca6", "marca7")
    return t.base.select("orden", mark.alias("refinanciada"))


@query(
    "e26_list_campaign",
    "SELECT evento, lista, CASE WHEN lista = '4251' THEN 'GMAC' WHEN lista = '4181' THEN 'PASH' WHEN length(lista) > 5 THEN lista "
    "ELSE 'CLARO' END AS campana FROM contactos",
)
def list_campaigns(t):
    return t.contactos.select("evento", "lista", classes.list_campaign("lista").alias("campana"))
