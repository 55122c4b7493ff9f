"""Stand-in inputs derived from the star-schema tables.

Each view is a table (or join) with expressions in the common subset of Spark
and ANSI SQL, so the query and its SQL twin start from the same rows. Values are
arithmetic on keys: valid, boundary, blank and malformed cases all occur.
"""

from __future__ import annotations

_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_SLASH = f"substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 1, 4)"
_BARE = (
    f"CAST(CAST(substr({_DAY}, 9, 2) AS INT) AS STRING) || '/' || "
    f"CAST(CAST(substr({_DAY}, 6, 2) AS INT) AS STRING) || '/' || substr({_DAY}, 1, 4)"
)
_MONEY = "CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 5 AS DECIMAL(18,2)) AS STRING)"
_LETTERS = "translate(CAST(o_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')"


def _cases(key: str, *values: str | None) -> str:
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values))
    return f"CASE ({key}) % {len(values)} {arms} END"


def _texts(key: str, *values: str | None) -> str:
    return _cases(key, *[None if v is None else "'" + v.replace("'", "''") + "'" for v in values])


def _mobile(factor: int, hole: int) -> str:
    number = f"CAST(3000000000 + (o_orderkey * {factor}) % 650000000 AS STRING)"
    return f"CASE WHEN o_orderkey % {hole} = 0 THEN NULL ELSE {number} END"


def _landline(factor: int, hole: int) -> str:
    number = f"CAST(6009999990 + (o_custkey * {factor}) % 90000000 AS STRING)"
    return f"CASE WHEN o_orderkey % {hole} = 0 THEN '' ELSE {number} END"


_BASE = {
    "orden": "o_orderkey",
    "identificacion": "CAST(o_custkey AS STRING)",
    "cuenta": "CAST(o_orderkey AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) || '-'",
    "cuenta2": "CAST(o_orderkey AS STRING) || '-'",
    "marca": _texts(
        "o_orderkey", "0", "30", "60", "90", "potencial", "prechurn", "castigo", "churn",
        "prepotencial", "Prepotencial Especial", "provision", "120", "otros",
    ),
    "origen": _texts("o_custkey", "ASCARD", "BSCS", "RR", "SGA"),
    "Mod_init_cta": (
        f"CASE WHEN o_orderkey % 97 = 5 THEN 'abc' WHEN o_orderkey % 89 = 7 THEN NULL "
        f"WHEN o_orderkey % 101 = 3 THEN '20000' WHEN o_orderkey % 103 = 4 THEN '2000000' ELSE {_MONEY} END"
    ),
    "descuento": _texts("o_orderkey", "0%", "7", "15%", None, "N/A", "Sin Descuento", "50%", "0"),
    "tipo_pago": _texts("o_orderkey", "", "Pago Parcial", "Sin Pago", None, "Pago Total", "Convenio"),
    "nombrecompleto": _cases(
        "o_custkey",
        f"'Sr. Juan Perez ' || {_LETTERS}",
        f"'SRA MARIA  DEL ' || {_LETTERS}",
        f"'Señor 12 Israel Ñuñez ' || {_LETTERS}",
        f"'a ANA_LU ' || {_LETTERS} || ' 3 & Hijos*'",
        f"'SR/SRA De La ' || {_LETTERS}",
        f"{_LETTERS}",
        f"'Senora Luz-Mar {{' || {_LETTERS} || '}} #9'",
        f"'José Ã‘ato ' || {_LETTERS} || ' Ruiz'",
    ),
    "referencia": _cases("o_orderkey", "'REF-' || CAST(o_orderkey AS STRING)", "''", None, "'12'"),
    "fecha_vencimiento": _SLASH,
    "fecha_corta": _BARE,
    "fecha_iso": _DAY,
    "fecha_asignacion": _cases("o_custkey", _BARE, _SLASH, "'31/31/2024'", "NULL"),
    "fechagestion_contactodirecto": _cases("o_orderkey", "'1998-01-01'", "''", "NULL", _DAY),
    "mejorperfil": _texts("o_custkey", "Promesa", "Al dia", "Reclamacion", "Reclamacion", None, "Colgo"),
    "ultimoperfil": _texts("o_orderkey", "Reclamacion", "Reclamacion", "Recordatorio", "Ya Pago", "No Contestan"),
    "perfil_historico": _texts("o_orderkey", "Reclamacion", "Renuente", "Reclamacion"),
    "mejorperfil_mes": _texts(
        "o_orderkey", "Promesa Parcial", "No Contestan", "Mensaje con Tercero", "otro", "Fallecido", "Colgo",
        "Gestion IVR", "Dificultad de Pago", None,
    ),
    "estado_ranking": _texts("o_orderkey", "", None, "GESTIONAR", "", "", "", ""),
    "cant_servicios": "CAST(o_orderkey % 3 AS STRING)",
    "customer_type_id": _texts("o_orderkey", "81", "84", "87", "79", "80", "89", "90", "x", None, "85"),
    "nombre_campana": _texts(
        "o_orderkey", "FLP 01", "FLP 02", "FLP 03", "Clientes Corporativos", "Otra", None,
        "PrePotencial Convergente Masivo_2",
    ),
    "marca_refinanciado": _texts("o_orderkey", "REFINANCIADO", "N", None),
    "ciudad": _texts(
        "o_custkey", "BOGOTA/CENTRO", "CALI VALLE", "", None, "MEDELLIN/SUR", "ASIGNACION_MANUAL_APPLE",
        "TUNJA", "SANTANDER DE QUILICHAO", "CALDAS", "HUILA/NEIVA",
    ),
    "plan": _texts("o_custkey", "A", "B", "C"),
    "min": _mobile(1299709, 7),
    "celular1": _mobile(7919, 11),
    "celular2": f"CASE WHEN o_orderkey % 5 = 0 THEN {_mobile(7919, 11)} ELSE {_mobile(104729, 3)} END",
    "celular3": _mobile(611953, 2),
    "celular4": f"CASE WHEN o_orderkey % 17 = 0 THEN 'sin dato' ELSE {_mobile(15485863, 4)} END",
    "fijo1": _landline(32452843, 5),
    "fijo2": _landline(49979687, 3),
    "email1": _cases(
        "o_orderkey",
        "'Persona' || CAST(o_custkey AS STRING) || '@correo.example'",
        "'ana@x.example'",
        "'notiene@nada.example'",
        "'uno' || CAST(o_custkey AS STRING) || '@a.example;dos@b.example'",
        "NULL",
        "'sin arroba'",
        "'maria lopez+' || CAST(o_orderkey AS STRING) || '@mail.example'",
    ),
    "email2": _cases(
        "o_custkey", "'cliente' || CAST(o_custkey AS STRING) || '@post.example'", "''", "'nocorreo'",
        "'cliente#' || CAST(o_custkey AS STRING) || '@gamil.example'",
    ),
    "marca5": _texts("o_orderkey", "Y", "N", "N", "N"),
    "marca6": _texts("o_orderkey", "N", "Y", "N", "N", "N"),
    "marca7": _texts("o_orderkey", "N", "N", "Y", "N", "N", "N", "N"),
    "refinanciada": _texts("o_custkey", "Y", "N", None),
    "edad": _texts("o_custkey", "0", "30", "60", "120", "150", "180", "210"),
    "documento": _cases(
        "o_custkey", "'CC' || CAST(o_custkey AS STRING)", "'PS' || CAST(o_custkey AS STRING)",
        "'XPP-' || CAST(o_custkey AS STRING)", "'NT' || CAST(o_custkey AS STRING)",
        "CAST(o_custkey AS STRING)", "'ZZ' || CAST(o_custkey AS STRING)", "NULL", "'PP'",
    ),
    "lista_telefonos": _cases(
        "o_orderkey",
        "'[\"30' || CAST(10000000 + o_orderkey AS STRING) || '\"|\"30' || CAST(20000000 + o_custkey AS STRING) || '\"]'",
        "'{\"31' || CAST(10000000 + o_custkey AS STRING) || '\" | }'",
        "NULL",
        "''",
    ),
}

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "base": ("orders", _BASE),
    "pagos": (
        "orders",
        {
            "orden": "o_orderkey",
            "archivo": "'pagos_' || CAST(o_orderkey % 4 AS STRING) || '.csv'",
            "tipo_operacion": _texts("o_orderkey", "PAGO", "ABONO", "AJUSTE", "PAGO", None),
            "obligacion": _cases(
                "o_orderkey", "CAST(o_custkey AS STRING) || '.' || CAST(o_orderkey % 7 AS STRING)",
                "CAST(o_orderkey AS STRING) || ',00'", "CAST(o_custkey AS STRING)",
            ),
            "fecha": _cases(
                "o_orderkey", _BARE, _SLASH, _DAY, f"{_DAY} || ' 10:30:00'", "'31/31/2024'",
                f"substr({_DAY}, 9, 2) || '-' || substr({_DAY}, 6, 2) || '-' || substr({_DAY}, 1, 4)",
                f"substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 3, 2)",
            ),
            "valor": _cases(
                "o_orderkey", f"translate({_MONEY}, '.', ',')", _MONEY, "'0'", "'abc'", "'0,01'",
                "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)", "NULL",
            ),
        },
    ),
    "contactos": (
        "events",
        {
            "evento": "event_id",
            "canal": "event_type",
            "cuenta_real": _cases("user_id", "CAST(user_id AS STRING) || '-'", "CAST(user_id AS STRING)", "' '", "NULL"),
            "cuenta": "CAST(user_id AS STRING)",
            "marca": _texts("user_id + event_id", "0", "30", "Castigo", "Potencial", "otra", "Churn"),
            "estado": _texts(
                "event_id", "AB", "PM", "AA", "ADC", "DROP", "NA", "NEW", "INCALL", "ERI", "MNC", "TOUT", "PDROP",
                "PU", "SVYEXT", "XFER", "SVYHU", "RARO", None, "ANSWERED",
            ),
            "lista": _texts("event_id", "4251", "4181", "CAMPANA_LARGA", "99", None),
            "telefono": "CAST(3000000000 + (event_id * 7919) % 700000000 AS STRING)",
            "perfil": _texts(
                "event_id", "Promesa", "Colgo", "Fallecido", "Mensaje con Tercero", "Al Dia", "desconocido", None,
            ),
            "disposicion": _texts("event_id", "ANSWER", "BUSY", "INVALID", "NO RING", "NO ANSWER", "VOICEMAIL", "OTRO", "ANSWER", "ANSWER"),
            "identidad": _texts("user_id", "confirmar_identidad", "negar_identidad", "familiar_conocido", "no_disponible", "repetir_pregunta", None, "nada"),
            "pago": _texts("event_id + user_id", "confirmacion_pago", None, "ya_pago", "respuesta_invalida", "propuesta_pago_valida", "x"),
            "momento": "CAST(CAST(ts AS DATE) AS STRING) || 'T10:00:00.000-05:00'",
            "dia": "CAST(CAST(ts AS DATE) AS STRING)",
        },
    ),
    "presencia": (
        "events",
        {
            "clave": "CAST(user_id AS STRING) || '-' || event_type",
            "dia": "CAST(substr(CAST(CAST(ts AS DATE) AS STRING), 9, 2) AS INT)",
            "fecha": (
                "CAST(CAST(substr(CAST(CAST(ts AS DATE) AS STRING), 9, 2) AS INT) AS STRING) || '/' || "
                "CAST(CAST(substr(CAST(CAST(ts AS DATE) AS STRING), 6, 2) AS INT) AS STRING) || '/' || "
                "substr(CAST(CAST(ts AS DATE) AS STRING), 1, 4)"
            ),
        },
    ),
    "envios": (
        "events",
        {
            "evento": "event_id",
            "momento": "CASE WHEN event_id % 53 = 0 THEN 'sin fecha' ELSE CAST(ts AS STRING) END",
            "campana": _cases(
                "user_id", "'Pash ' || event_type", "'GM insoluto 210'", "'Prechurn 30_' || event_type",
                "'Puntored'", "'Ya Dinero rr'", "'QNT habi'", "'Otra ' || event_type", "'Pay Joy esp'", "NULL",
            ),
            "remitente": "event_type || '@envios.example'",
            "tipo": _texts("event_id", "Estandar", "Personalizado"),
            "valor": "CASE WHEN event_id % 41 = 0 THEN 'n/d' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END",
            "costo": "CAST(CAST(value AS DECIMAL(18,2)) AS STRING)",
            "estado_llamada": _texts("event_id", "CONTESTADORA", "humano", "Contestadora", "ocupado", None),
            "canal": "event_type",
        },
    ),
    "lago": (
        "customer",
        {
            "document": "CAST(c_custkey AS STRING)",
            "account": "CAST(c_custkey * 3 AS STRING)",
            "demographic": _cases(
                "c_custkey", "CAST(3000000000 + c_custkey AS STRING)", "CAST(6010000000 + c_custkey AS STRING)",
                "'cliente' || CAST(c_custkey AS STRING) || '@post.example'", "'00 300-123' || CAST(1000 + c_custkey % 9000 AS STRING)",
                "'12345'",
            ),
        },
    ),
    "nuevos": (
        "orders",
        {
            "document": "CAST(o_custkey AS STRING)",
            "account": "CAST(o_custkey * 3 AS STRING)",
            "demographic": _cases(
                "o_custkey", "CAST(3000000000 + o_custkey AS STRING)",
                "CAST(6010000000 + o_orderkey % 5000 AS STRING)",
                "'cliente' || CAST(o_custkey AS STRING) || '@post.example'", "'abc'",
            ),
        },
    ),
}


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    return f"SELECT {', '.join(f'{expr} AS {column}' for column, expr in columns.items())} FROM {source}"
