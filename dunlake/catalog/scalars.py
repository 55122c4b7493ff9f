"""Scalar functions F1-F24 over the stand-in views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from dunlake.catalog import sqltext as q
from dunlake.catalog.registry import query
from dunlake.functions import accounts, amounts, contacts, dates, messages, names

AS_OF = date(2001, 6, 15)


@query(
    "f1_clean_name",
    f"""
    SELECT nombrecompleto, {q.clean_name('nombrecompleto')} AS limpio, {q.clean_name_literal('nombrecompleto')} AS literal,
      CASE WHEN length({q.clean_name_literal('nombrecompleto')}) < 7 THEN nombrecompleto
      ELSE {q.clean_name_literal('nombrecompleto')} END AS conservado, CAST(count(*) AS BIGINT) AS filas FROM base GROUP BY 1
    """,
)
def clean_names(t):
    counted = t.base.groupBy("nombrecompleto").agg(F.count("*").alias("filas"))
    return counted.withColumns(
        {
            "limpio": names.clean_name("nombrecompleto"),
            "literal": names.clean_name_literal("nombrecompleto"),
        }
    ).withColumn("conservado", names.cleaned_or_original("literal", "nombrecompleto"))


@query(
    "f2_short_name",
    f"SELECT nombrecompleto, {q.short_name('nombrecompleto')} AS corto, CAST(count(*) AS BIGINT) AS filas FROM base GROUP BY 1",
)
def short_names(t):
    counted = t.base.groupBy("nombrecompleto").agg(F.count("*").alias("filas"))
    return counted.withColumn("corto", names.short_name("nombrecompleto"))


@query(
    "f3_split_name",
    """
    SELECT nombrecompleto, array_to_string(p[1:n // 2 + n % 2], ' ') AS nombres, array_to_string(p[n // 2 + 1:n], ' ') AS apellidos,
      CAST(count(*) AS BIGINT) AS filas FROM (SELECT nombrecompleto, str_split(nombrecompleto, ' ') AS p,
      length(str_split(nombrecompleto, ' ')) AS n FROM base) GROUP BY ALL
    """,
)
def split_names(t):
    counted = t.base.groupBy("nombrecompleto").agg(F.count("*").alias("filas"))
    return counted.select(
        "nombrecompleto",
        names.given_names("nombrecompleto").alias("nombres"),
        names.surnames("nombrecompleto").alias("apellidos"),
        "filas",
    )


@query(
    "f4_clean_account",
    """
    SELECT orden, replace(cuenta, '-', '') AS sin_guion, replace(replace(cuenta, '-', ''), '.', '') AS sin_puntos,
      cuenta2 || '-' AS guardada, regexp_replace(orden || '.' || (orden % 2), '\\.0$', '') AS sin_cero,
      right(replace(CAST(1000000000000 + orden AS VARCHAR) || '.5', '.', ''), 9) AS ultimos,
      split_part(replace('1.' || orden || ',00', '.', ''), ',', 1) AS entero FROM base
    """,
)
def clean_accounts(t):
    as_text = F.col("orden").cast("string")
    return t.base.select(
        "orden",
        accounts.without_dashes("cuenta").alias("sin_guion"),
        accounts.without_points("cuenta").alias("sin_puntos"),
        accounts.guarded("cuenta2").alias("guardada"),
        accounts.without_zero_decimal(F.concat(as_text, F.lit("."), F.col("orden") % 2)).alias("sin_cero"),
        accounts.last_nine(F.concat(F.lit(1000000000000) + F.col("orden"), F.lit(".5"))).alias("ultimos"),
        accounts.before_comma(F.concat(F.lit("1."), as_text, F.lit(",00"))).alias("entero"),
    )


@query(
    "f5_composite_key",
    "SELECT orden, cuenta || '-' || celular1 AS llave, celular1 || identificacion AS cruce FROM base",
)
def composite_keys(t):
    return t.base.select(
        "orden",
        accounts.composite_key("cuenta", "celular1").alias("llave"),
        accounts.composite_key("celular1", "identificacion", separator="").alias("cruce"),
    )


@query(
    "f6_digits_and_letters",
    "SELECT orden, regexp_replace(documento, '[^0-9]', '', 'g') AS digitos, regexp_replace(documento, '[^a-zA-Z]', '', 'g') AS letras FROM base",
)
def digits_and_letters(t):
    return t.base.select(
        "orden",
        accounts.digits_only("documento").alias("digitos"),
        accounts.letters_only("documento").alias("letras"),
    )


@query(
    "f7_discounted_amount",
    f"""
    SELECT orden, {q.discounted('Mod_init_cta', q.plain_discount('descuento'))} AS valor,
      CASE WHEN coalesce(TRY_CAST(replace(descuento, '%', '') AS DOUBLE), 0) = 0 THEN 0.0 ELSE round(TRY_CAST(Mod_init_cta AS DOUBLE)
      * (1 - TRY_CAST(replace(descuento, '%', '') AS DOUBLE) / 100), 4) END AS valor_o_cero FROM base
    """,
)
def discounted_amounts(t):
    return t.base.select(
        "orden",
        amounts.discounted("Mod_init_cta", amounts.plain_discount("descuento")).alias("valor"),
        F.round(amounts.discounted_or_zero("Mod_init_cta", "descuento"), 4).alias("valor_o_cero"),
    )


@query(
    "f8_money_text",
    """
    SELECT orden, '$ ' || replace(format('{:,}', CAST(trunc(TRY_CAST(Mod_init_cta AS DOUBLE)) AS BIGINT)), ',', '.') AS moneda,
      '$ ' || format('{:,}', CAST(trunc(TRY_CAST(Mod_init_cta AS DOUBLE)) AS BIGINT)) AS moneda_correo FROM base
    """,
)
def money_texts(t):
    return t.base.select(
        "orden",
        amounts.money_text("Mod_init_cta").alias("moneda"),
        amounts.money_text("Mod_init_cta", ",").alias("moneda_correo"),
    )


@query(
    "f9_decimal_swap",
    """
    SELECT orden, replace(valor, '.', ',') AS con_coma, TRY_CAST(replace(valor, ',', '.') AS DOUBLE) AS numero,
      coalesce(TRY_CAST(replace(valor, ',', '.') AS DOUBLE), 0) >= 0.01 AS sirve FROM pagos
    """,
)
def decimal_swaps(t):
    return t.pagos.select(
        "orden",
        amounts.decimal_comma("valor").alias("con_coma"),
        amounts.parsed_amount("valor").alias("numero"),
        amounts.usable_amount("valor").alias("sirve"),
    )


@query(
    "f10_payment_date",
    f"SELECT orden, fecha, coalesce(CAST({q.payment_date('fecha')} AS VARCHAR), fecha) AS iso FROM pagos",
)
def payment_dates(t):
    return t.pagos.select("orden", "fecha", dates.iso_date("fecha").alias("iso"))


@query(
    "f11_days_between",
    f"""
    SELECT orden, fecha_asignacion, fecha_vencimiento,
      date_diff('day', {q.slash_date('fecha_vencimiento')}, {q.slash_date('fecha_asignacion')}) AS dias FROM base
    """,
)
def day_differences(t):
    return t.base.select(
        "orden",
        "fecha_asignacion",
        "fecha_vencimiento",
        dates.days_between("fecha_asignacion", "fecha_vencimiento").alias("dias"),
    )


@query(
    "f12_days_past_due",
    "SELECT orden, date_diff('day', CAST(fecha_iso AS DATE), DATE '2001-06-15') AS dias FROM base",
)
def past_due(t):
    return t.base.select("orden", dates.days_past_due(F.col("fecha_iso").cast("date"), AS_OF).alias("dias"))


@query(
    "f13_timestamp_parts",
    """
    SELECT evento, replace(replace(momento, 'T', ' '), '.000-05:00', '') AS limpio,
      split_part(replace(momento, 'T', ' '), ' ', 1) AS dia, substr(split_part(momento, 'T', 2), 1, 2) AS hora,
      split_part('08:00,12:00,' || evento, ',', 1) AS entrada, CAST(evento AS VARCHAR) AS salida FROM contactos
    """,
)
def timestamp_parts(t):
    listed = F.concat(F.lit("08:00,12:00,"), F.col("evento"))
    return t.contactos.select(
        "evento",
        dates.plain_timestamp("momento").alias("limpio"),
        dates.day_part(dates.plain_timestamp("momento")).alias("dia"),
        dates.hour_part(F.split_part("momento", F.lit("T"), F.lit(2))).alias("hora"),
        dates.first_item(listed).alias("entrada"),
        dates.last_item(listed).alias("salida"),
    )


@query(
    "f14_floor_time",
    """
    SELECT CAST(date_trunc('day', TRY_CAST(momento AS TIMESTAMP)) AS VARCHAR) AS dia,
      CAST(date_trunc('hour', TRY_CAST(momento AS TIMESTAMP)) AS VARCHAR) AS hora, CAST(count(*) AS BIGINT) AS filas FROM envios GROUP BY 1, 2
    """,
)
def floored_times(t):
    floored = t.envios.groupBy(dates.floor_to("momento", "DAY").alias("d"), dates.floor_to("momento", "HOUR").alias("h"))
    return floored.agg(F.count("*").alias("filas")).select(
        F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("dia"), F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hora"), "filas"
    )


_REFERENCE = "replace(CASE WHEN origen = 'RR' THEN cuenta ELSE referencia END, '-', '')"


@query(
    "f15_reference",
    f"""
    SELECT orden, CASE WHEN {_REFERENCE} <> '' THEN {_REFERENCE} ELSE 'SIN REFERENCIA' END AS numero,
      CASE WHEN referencia <> '' THEN 'Con referencia' ELSE 'SIN REFERENCIA' END AS filtro,
      CASE WHEN length(referencia) > 3 THEN 'Con referencia' ELSE 'Sin Referencia' END AS filtro_largo,
      CASE WHEN referencia IS NOT NULL THEN referencia WHEN origen = 'RR' THEN 'RR' ELSE '0' END AS base_referencia FROM base
    """,
)
def references(t):
    return t.base.select(
        "orden",
        accounts.reference_number("origen", "cuenta", "referencia").alias("numero"),
        accounts.reference_flag("referencia").alias("filtro"),
        accounts.reference_flag_by_length("referencia").alias("filtro_largo"),
        accounts.default_reference("referencia", "origen").alias("base_referencia"),
    )


@query(
    "f16_joined_lines",
    """
    SELECT orden, regexp_replace(coalesce(celular1, '') || ',' || coalesce(celular2, '') || ',' || coalesce(celular3, '') || ',' ||
      coalesce(fijo1, '') || ',' || coalesce(fijo2, ''), ',,+', ',', 'g') AS lineas FROM base
    """,
)
def line_lists(t):
    return t.base.select(
        "orden", accounts.joined_lines("celular1", "celular2", "celular3", "fijo1", "fijo2").alias("lineas")
    )


@query(
    "f17_without_pipes",
    "SELECT orden, replace(lista_telefonos, '|', '') AS lista_telefonos, replace('a|' || ciudad, '|', '') AS ciudad FROM base",
)
def pipeless(t):
    rows = t.base.select("orden", "lista_telefonos", F.concat(F.lit("a|"), F.col("ciudad")).alias("ciudad"))
    return accounts.without_pipes(rows)


_FIELDS = (
    "SELECT orden, origen, coalesce(referencia, '') AS referencia, descuento, coalesce(Mod_init_cta, '') AS Form_Moneda, "
    "plan AS PRODUCTO, ciudad AS NOMBRE_CORTO FROM base"
)


@query(
    "f18_message_texts",
    f"""
    SELECT orden, CASE WHEN origen = 'ASCARD' THEN 'La cuota de su ' || PRODUCTO || ' es ' || Form_Moneda || ', referencia ' || referencia || '.'
      ELSE 'Su saldo es ' || Form_Moneda || ' con referencia ' || referencia || '.' END AS mensaje_1,
      coalesce(NOMBRE_CORTO, '') || ', pague hoy ' || Form_Moneda || ' y mantenga activo su servicio ' || PRODUCTO || '.' AS mensaje_2,
      CASE WHEN descuento IS NULL THEN 'N/A' ELSE coalesce(NOMBRE_CORTO, '') || ', tiene un descuento del ' || descuento || ' sobre '
      || Form_Moneda || '.' END AS mensaje_3 FROM ({_FIELDS})
    """,
)
def message_texts(t):
    rows = t.base.selectExpr(
        "orden", "origen", "coalesce(referencia, '') AS referencia", "descuento",
        "coalesce(Mod_init_cta, '') AS Form_Moneda", "plan AS PRODUCTO", "ciudad AS NOMBRE_CORTO",
    )
    texts = messages.message_columns(messages.SAMPLE_TEXTS, "origen", rows.columns)
    return rows.select("orden", *[message.alias(name) for name, message in texts.items()])


@query(
    "f19_free_template",
    "SELECT orden, 'Cuenta ' || cuenta || ' de ' || coalesce(ciudad, '') || ': ' || coalesce(Mod_init_cta, '') AS MESSAGE FROM base",
)
def free_template(t):
    rows = t.base
    return rows.select(
        "orden", messages.fill_template("Cuenta (CUENTA) de (ciudad): (mod_init_cta)", rows.columns).alias("MESSAGE")
    )


@query(
    "f20_contact_key_text",
    r"""
    SELECT orden, regexp_replace(replace(replace(replace(dato, '57- ', ''), '57-', ''), '57 - ', ''), '[A-Z*\s-]', '', 'g') AS limpio,
      replace(replace(marca_linea, 'VDK', '9999999999'), 'VD', '9999999999') AS marcado
    FROM (SELECT orden, CASE orden % 4 WHEN 0 THEN '57-' || celular1 WHEN 1 THEN '57 - ' || celular1 WHEN 2 THEN 'TEL* ' || celular1
      ELSE '57- ' || celular1 END AS dato, CASE orden % 3 WHEN 0 THEN 'VDK' WHEN 1 THEN 'VD1' ELSE celular1 END AS marca_linea FROM base)
    """,
)
def contact_key_texts(t):
    kind = F.col("orden") % 4
    dato = (
        F.when(kind == 0, F.concat(F.lit("57-"), "celular1"))
        .when(kind == 1, F.concat(F.lit("57 - "), "celular1"))
        .when(kind == 2, F.concat(F.lit("TEL* "), "celular1"))
        .otherwise(F.concat(F.lit("57- "), "celular1"))
    )
    mark = F.when(F.col("orden") % 3 == 0, "VDK").when(F.col("orden") % 3 == 1, "VD1").otherwise(F.col("celular1"))
    return t.base.select(
        "orden", contacts.strip_contact_key(dato).alias("limpio"), contacts.mark_placeholder(mark).alias("marcado")
    )


@query(
    "f21_update_view",
    f"""
    SELECT orden, replace(replace(cuenta, '-', ''), '.', '') AS cuenta,
      CASE WHEN length(numero) < 2 THEN replace(replace(cuenta, '-', ''), '.', '') ELSE numero END AS cliente,
      CAST({q.slash_date('fecha_asignacion')} AS VARCHAR) AS asignada, CAST({q.slash_date('fecha_corta')} AS VARCHAR) AS vence,
      '' AS precio FROM (SELECT *, CAST(coalesce(TRY_CAST(regexp_replace(documento, '[^0-9]', '', 'g') AS BIGINT), 0) AS VARCHAR) AS numero FROM base)
    """,
)
def update_view(t):
    return t.base.select(
        "orden",
        accounts.without_points("cuenta").alias("cuenta"),
        accounts.client_number("documento", "cuenta").alias("cliente"),
        dates.slash_date("fecha_asignacion").cast("string").alias("asignada"),
        dates.slash_date("fecha_corta").cast("string").alias("vence"),
        F.lit("").alias("precio"),
    )


@query("f22_country_code", "SELECT orden, '57' || celular1 AS telefono FROM base")
def country_codes(t):
    return t.base.select("orden", contacts.with_country_code("celular1").alias("telefono"))


@query(
    "f23_file_name_stamp",
    """
    SELECT orden, nombre, CASE WHEN orden % 5 = 4 THEN NULL ELSE fecha_iso END AS fecha,
      CASE WHEN orden % 5 IN (3, 4) THEN NULL ELSE '09:30' END AS hora FROM (
    SELECT orden, fecha_iso, CASE orden % 5 WHEN 3 THEN 'base_' || sello || '_99xx.csv' WHEN 4 THEN 'suelto.csv' ELSE
      'base_' || sello || '_0930 copia.csv' END AS nombre
    FROM (SELECT orden, fecha_iso, substr(fecha_iso, 9, 2) || substr(fecha_iso, 6, 2) || substr(fecha_iso, 1, 4) AS sello FROM base))
    """,
)
def file_stamps(t):
    stamp = "substr(fecha_iso, 9, 2) || substr(fecha_iso, 6, 2) || substr(fecha_iso, 1, 4)"
    named = t.base.selectExpr(
        "orden",
        f"CASE orden % 5 WHEN 3 THEN 'base_' || {stamp} || '_99xx.csv' WHEN 4 THEN 'suelto.csv' "
        f"ELSE 'base_' || {stamp} || '_0930 copia.csv' END AS nombre",
    )
    return named.select(
        "orden",
        "nombre",
        dates.file_name_date("nombre").cast("string").alias("fecha"),
        dates.file_name_time("nombre").alias("hora"),
    )


@query(
    "f24_thousands",
    """
    SELECT orden, TRY_CAST(replace(texto, '.', '') AS BIGINT) AS numero FROM (SELECT orden, CASE WHEN orden % 9 = 0 THEN 'n.d.'
      ELSE replace(format('{:,}', orden * 7919), ',', '.') END AS texto FROM base)
    """,
)
def thousands(t):
    shown = F.when(F.col("orden") % 9 == 0, F.lit("n.d.")).otherwise(
        F.replace(F.format_number(F.col("orden") * 7919, 0), F.lit(","), F.lit("."))
    )
    return t.base.select("orden", amounts.without_thousands(shown).alias("numero"))
