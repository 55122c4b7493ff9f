"""Labels, codes, word lists and limits that results must carry."""

# --- fixed values: debt and day bands -------------------------------------
DEBT_EDGES = (20_000, 50_000, 100_000, 150_000, 200_000, 300_000, 500_000, 1_000_000, 2_000_000)
DEBT_LABELS = (
    "1 Menos a 20 mil",
    "2 Entre 20 a 50 mil",
    "3 Entre 50 a 100 mil",
    "4 Entre 100 a 150 mil",
    "5 Entre 150 mil a 200 mil",
    "6 Entre 200 mil a 300 mil",
    "7 Entre 300 mil a 500 mil",
    "8 Entre 500 mil a 1 Millon",
    "9 Entre 1 a 2 millones",
)
DEBT_ABOVE = "9.1 Mayor a 2 millones"
NO_DISCOUNT_BAND = "0 No Aplica"

DAY_BANDS = (
    (1, 4, "1 Entre 1 a 4 dias"),
    (5, 8, "2 Entre 5 a 8 dias"),
    (9, 12, "3 Entre 9 a 12 dias"),
    (13, 16, "4 Entre 13 a 16 dias"),
    (17, 20, "5 Entre 17 a 20 dias"),
    (21, 24, "6 Entre 21 a 24 dias"),
    (25, 28, "7 Entre 25 a 28 dias"),
    (29, 31, "8 Entre 29 a 31 dias"),
)
NOT_YET_DUE_BAND = (-30, 0, "0 Entre 0 y menos de 30 dias")
LONG_OVERDUE_BAND = (32, 100, "9 Entre 32 a 100 dias")
OUT_OF_RANGE = "Fuera de rango"
NULL_BAND = "Nulo"

# --- fixed values: contact ranges ------------------------------------------
MOBILE_RANGE = (3_000_000_009, 3_599_999_999)
LANDLINE_RANGE = (6_010_000_009, 6_089_999_999)
REORDER_LANDLINE_RANGE = (6_010_000_000, 6_089_999_999)
LAKE_MOBILE_RANGE = (3_000_000_001, 3_599_999_998)
LAKE_LANDLINE_RANGE = (6_010_000_001, 6_089_999_998)
COUNTED_LANDLINE_RANGE = (6_000_000_009, 6_599_999_999)
REBUILT_LANDLINE_RANGE = (6_010_000_000, 6_089_999_998)
LANDLINE_FROM = 6_000_000_000
COUNTRY_CODE = "57"
PHONE_SLOTS = 20
REORDER_SLOTS = 13
TASK_SLOTS = 9
EMAIL_SLOTS = 5

# --- fixed values: area digit by place -------------------------------------
AREA_BY_PLACE = {
    "1": ("BOGOTA", "CUNDINAMARCA", "SOACHA", "BOGOTÁ", "BOGOT"),
    "2": ("CAUCA", "NARIÑO", "VALLE", "CALI", "JAMUNDI", "JAMUNDÍ"),
    "4": ("ANTIOQUIA", "BARRANQUILLA", "CORDOBA", "CHOCO", "MEDELLÍN", "MEDELLIN", "MEDELL"),
    "5": ("ATLANTICO", "BOLIVAR", "CESAR", "LA GUAJIRA", "MAGDALENA", "SUCRE"),
    "6": ("CALDAS", "QUINDIO", "RISARALDA"),
    "7": ("ARAUCA", "NORTE DE SANTANDER", "SANTANDER"),
    "8": (
        "AMAZONAS", "BOYACA", "CASANARE", "CAQUETA", "GUAVIARE", "GUAINIA", "HUILA", "META",
        "TOLIMA", "PUTUMAYO", "SAN ANDRES", "VAUPES", "VICHADA",
    ),
}
DEFAULT_PLACE = "BOGOTA"

# --- fixed values: departments ----------------------------------------------
DEPARTMENTS = (
    "ARAUCA", "CASANARE", "CAUCA", "CHOCO", "N. DE SANTANDER", "GUAVIARE", "CESAR", "CORDOBA",
    "SANTANDER", "CAQUETA", "CALDAS", "SAN ANDRES", "MAGDALENA", "LA GUAJIRA", "RISARALDA",
    "QUINDIO", "SUCRE", "GUAINIA", "PUTUMAYO", "VAUPES", "ANTIOQUIA", "HUILA", "VICHADA",
    "ATLANTICO", "META", "AMAZONAS", "BOLIVAR", "CUNDINAMARCA", "BOYACA", "NARINO",
    "VALLE DEL CAUCA", "TOLIMA",
)
EMPTY_PLACE = "VACIO"
UNKNOWN_DEPARTMENT = "NO IDENTIFICADO"

# --- fixed values: origins, brands and document kinds ------------------------
ORIGINS = ("ASCARD", "RR", "BSCS", "SGA")
ORIGIN_LABELS = {
    "sms": {"BSCS": "Postpago", "ASCARD": "Equipo", "RR": "Hogar", "SGA": "Negocios"},
    "bot": {"BSCS": "Linea Movil", "ASCARD": "Equipo", "RR": "Hogar", "SGA": "Negocios"},
    "email": {
        "BSCS": "Cuenta Postpago",
        "ASCARD": "Equipo Financiado",
        "RR": "Cuenta Hogar",
        "SGA": "Cuenta Negocios",
    },
    "dashboard": {"Postpago": "BSCS", "Equipo": "ASCARD", "Hogar": "RR", "Negocios": "SGA"},
}
BOX_CODES = {"BSCS": "P009-5", "ASCARD": "P009-6", "RR": "P009-4", "SGA": "N/A"}
BOX_ERROR = "Error"

TOUCH_BRANDS = (
    "0", "30", "potencial", "prechurn", "churn", "prepotencial", "60", "90", "120", "150", "180",
    "210", "apple manual", "prepotencial especial", "castigo", "provision", "preprovision",
)
BRAND_GROUPS = {
    "Todo": (
        "0", "30", "60", "90", "120", "150", "180", "210", "prechurn", "potencial", "castigo",
        "churn", "preprovision", "prepotencial", "provision", "otros",
    ),
    "Todo - Castigo": (
        "0", "30", "60", "90", "120", "150", "180", "210", "prechurn", "potencial", "churn",
        "preprovision", "prepotencial", "provision", "otros",
    ),
    "0 - 30": ("0", "30"),
    "60 - 210": ("60", "90", "120", "150", "180", "210"),
    "Especiales": ("prechurn", "potencial", "churn", "preprovision", "provision", "prepotencial"),
}
IMPLIED_BRANDS = {
    "potencial": "potencial a castigar",
    "prepotencial": "prepotencial especial",
    "otros": "apple manual",
}
SPECIAL_RANKING_BRANDS = ("Prepotencial Especial", "churn", "prechurn", "prepotencial", "potencial")
LISTED_BRANDS = ("30", "potencial", "prechurn", "castigo")
OLD_BRANDS = ("60", "90", "120", "150", "180", "210", "Castigo", "Provision", "Preprovision")
SPECIAL_CAMPAIGNS = ("PrePotencial Convergente Masivo_2", "PrePotencial Convergente Pyme_2")
PERSON_SEGMENT_CODES = ("81", "84", "87")
DOCUMENT_TYPES = {
    "CC": "Cedula de Ciudadania",
    "PS": "Pasaporte",
    "PP": "Pasaporte",
    "XPP": "Permiso de Permanencia",
    "NT": "Nit",
    "CD": "Carnet Diplomatico",
    "CE": "Cedula de Extranjeria",
}
OPEN_PAYMENT_TYPES = ("", "Pago Parcial", "Sin Pago")
NO_DISCOUNT_TEXTS = ("0%", "0", "N/A")
NO_RANKING = "NO APLICA FILTRO RANKING"
RETIRE = "RETIRAR"
MANUAL_CITY = "ASIGNACION_MANUAL_APPLE"
MANUAL_BRAND = "Apple Manual"
NEVER_CONTACTED = "2000-04-30"
BAD_PROFILES = (
    "Al dia", "Fallecido", "Numero Errado", "Paz y Salvo", "Posible Fraude", "Reclamacion", "Ya Pago",
)
COMPLAINT_PROFILE = "Reclamacion"

# --- fixed values: contact groups of a call profile --------------------------
PROFILE_GROUPS = {
    "aldia": "CDIR",
    "colgo": "CIND",
    "dificultaddepago": "CDIR",
    "fallecido": "NOC",
    "interesadoenpagar": "CDIR",
    "mensajecontercero": "CIND",
    "noasumedeuda": "CDIR",
    "nocontestan": "NOC",
    "numeroerrado": "NOC",
    "posiblefraude": "CDIR",
    "promesa": "CDIR",
    "promesaincumplida": "CDIR",
    "promesaparcial": "CDIR",
    "reclamacion": "CDIR",
    "recordatorio": "CDIR",
    "renuente": "CDIR",
    "terceronotomamensaje": "CIND",
    "volverallamar": "CDIR",
    "yapago": "CDIR",
    "singestion": "NOC",
    "gestionivr": "CIND",
}

# --- fixed values: dialer status codes ----------------------------------------
DIALER_TEXT = {
    "AB": "Buzon de voz lleno",
    "PM": "Se inicia mensaje y cuelga",
    "AA": "Maquina contestadora",
    "ADC": "Numero fuera de servicio",
    "DROP": "No contesta",
    "NA": "No contesta",
    "NEW": "Contacto sin marcar",
    "INCALL": "Llamada en curso",
    "ERI": "Error de agente",
    "MNC": "Marcacion Next Call",
    "TOUT": "Error de salida temporal",
    "PDROP": "Error desde el operador",
    "PU": "Cuelga llamada",
    "SVYEXT": "Llamada transferida al agente",
    "XFER": "Se reprodujo mensaje completo",
    "SVYHU": "Cuelga durante una transferencia",
}
DIALER_ONLY_PREDICTIVE = ("INCALL", "ERI", "MNC", "TOUT")
DIALER_PROFILE = {
    "AB": "No Contestan",
    "PM": "Volver a Llamar",
    "AA": "No Contestan",
    "ADC": "No Contestan",
    "DROP": "No Contestan",
    "NA": "No Contestan",
    "NEW": "Volver a Llamar",
    "INCALL": "Interesado en Pagar",
    "ERI": "No Contestan",
    "MNC": "Interesado en Pagar",
    "TOUT": "No Contestan",
    "PDROP": "No Contestan",
    "PU": "Colgo",
    "SVYEXT": "Interesado en Pagar",
    "XFER": "Interesado en Pagar",
    "SVYHU": "Interesado en Pagar",
}
DIALER_INEFFECTIVE = ("AB", "DROP", "NA", "AA", "ADC", "ERI", "TOUT", "PDROP")
DIALER_NOT_DIALED = "NEW"
IVR_COUNTED = (
    "Buzon de voz lleno", "Se inicia mensaje y cuelga", "Maquina contestadora", "Cuelga llamada",
    "Llamada transferida al agente", "Se reprodujo mensaje completo",
    "Cuelga durante una transferencia", "EFECTIVO", "MARCADO", "NO EFECTIVO", "PARA REMARCAR",
    "ANSWERED", "BUSY", "NO ANSWER",
)

# --- fixed values: bot answers ---------------------------------------------------
BOT_AGREED = ("confirmacion_pago", "propuesta_pago_valida")
BOT_PAID = "ya_pago"
BOT_REFUSED = ("respuesta_invalida", "negacion_pago")
BOT_IDENTITY = {
    "confirmar_identidad": "TITULAR",
    "negar_identidad": "EQUIVOCADO",
    "familiar_conocido": "TERCERO",
    "no_disponible": "TERCERO",
    "repetir_pregunta": "SIN CONFIRMAR TITULARIDAD",
    "respuesta_invalida": "SIN CONFIRMAR TITULARIDAD",
}
BOT_UNANSWERED = {"NO RING": "NO TIMBRA", "NO ANSWER": "NO RESPONDIDO", "VOICEMAIL": "BUZON DE VOZ"}

# --- fixed values: ranking states ---------------------------------------------------
RANKING_STATES = {
    "NOFIJA": "NO RECUPERADA",
    "SIFIJA": "RECUPERADA",
    "NOMOVIL": "NO GESTIONAR",
    "AJUSTEMOVIL": "GESTIONAR",
    "PENDIENTEMOVIL": "GESTIONAR",
    "PAGO TOTAL NO RXMOVIL": "NO GESTIONAR",
    "PAGO TOTAL NO_RXMOVIL": "NO GESTIONAR",
    "PAGO TOTAL NO-RX": "NO GESTIONAR",
    "PAGO TOTAL SI RXMOVIL": "NO GESTIONAR",
    "PAGO TOTAL SI_RXMOVIL": "NO GESTIONAR",
    "PAGO TOTAL SI-RX": "NO GESTIONAR",
    "SIMOVIL": "GESTIONAR",
}
COLLECTION_MARKS = ("GESTION RECAUDO", "GESTION_RECAUDO", "GESTIÓN_RECAUDO", "GESTIÓN RECAUDO")
COLLECTION_STATE = "GESTION RECAUDO"

# --- fixed values: e-mail word lists --------------------------------------------------
BAD_EMAIL_PARTS = (
    "notiene", "nousa", "nobrinda", "000@00.com.co", "nolorecuerda", "notengo", "noposee",
    "nosirve", "notien", "noutili", "nomanej", "nolegust", "nohay", "nocorreo", "noindic",
    "@gamil", "pendienteconfirmar", "sincorr", "pendienteporcrearclaro", "correo.claro",
    "crearclaro", ":", "|", " ", "porcrear", "+", "#", "@xxx", "-", "@claro", "suministra",
    "factelectronica", "nodispone",
)
BLANKED_EMAIL_PATTERNS = (
    "notiene", "nousa", "nobrinda", "000@00.com.co", "nolorecuerda", "notengo", "noposee",
    "nosirve", "notien", "noutili", "nomanej", "nolegust", "nohay", "nocorreo", "noindic",
    "@gamil", "pendienteconfirmar", "sincorreo", "pendienteporcrearclaro", "correo.clarocrearclaro",
)
BLANKED_EMAIL_PHRASE = "sin segmento"
STRIPPED_EMAIL_CHARACTERS = "#/<>*¡!-}{+ "

# --- fixed values: person-name cleaning, in the order they are applied ------------------
ENYE_FORMS = ("ÃƒÂ‘", "Ã‚Â¦", "Ã‘", "Ñ", "NNNNN")
MOJIBAKE_LETTERS = (("Ã‡", "A"), ("ÃƒÂ", "I"))
TITLE_PATTERNS = (
    "SR/SRA", "SR./SRA.", "SR/SRA.", "SR.", "SRA.", "SR(A).", "SR ", "SRA ", "SR(A)",
)
NAME_SYMBOLS = ".#/<>*"
COURTESY_TITLES = ("SENORES ", "SENORA ", "SENOR ", "SENORA ")
NAME_SYMBOLS_AFTER_TITLES = "¡!_-}{+"
NAME_QUESTION_MARKS = "?¿"
CLIPPED_TITLES = ("SEORES ", "SEORA ", "SEOR ", "SEORA ")
LITERAL_NAME_PARTS = (
    "SR/SRA", "SR./SRA.", "SR/SRA.", "SR.", "SRA.", "SR(A).", "SR ", "SRA ", "SR(A)",
    "\\.", "#", "$", "/", "<", ">", "\\*", "SEÑORES ", "SEÑOR(A) ", "SEÑOR ", "SEÑORA ", "SENORES ",
    "SENOR(A) ", "SENOR ", "SENORA ", "¡", "!", "\\?¿", "_", "-", "}", "\\{", "\\+",
    "0 ", "1 ", "2 ", "3 ", "4 ", "5 ", "6 ", "7 ", "8 ", "9 ",
    "0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "  ",
)
LITERAL_ENYE_FORMS = ("\\ÃƒÂ‘", "\\Ã‚Â¦", "\\Ã‘", "Ñ", "ÃƒÂ‘", "Ã‚Â¦", "Ã‘", "NNNNN")

# --- fixed values: text date formats, tried in this order --------------------------------
PAYMENT_DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "d/M/yy", "d-M-yy")

# --- fixed values: payment, ranking and agency column aliases ------------------------------
HOUSE_COLUMN = "Nombre Casa de Cobro"
CAMPAIGN_CODE_COLUMN = "Codigo de Campaña"
OWN_CAMPAIGN_CODE = "UNIF - RECUPERA SAS"
PAYMENT_ALIASES = {
    "obligacion": ("Cuenta", "CUENTA", "Número de Cliente"),
    "valor": ("Pago", "PAGO", "MONTO", "Fecha de Creación"),
    "fecha": ("Fecha", "FECHA_APLICACION", "FECHA_INGRESO", "Nombre Casa de Cobro"),
}
UNAPPLIED_ALIASES = {
    "CUENTA": ("REFERENCIA_DIVIDIDA", "REFERENCIA DIVIDIDA", "CUSTCODE", "CUENTA"),
    "VALOR": ("MONTO", "PAGO", "VALOR"),
}
RANKING_ALIASES = {
    "cuenta": ("raiz", "cuenta"),
    "agencia": ("aliado", "casa", "casacobro", "agencia"),
    "servicios": ("nservicios",),
    "pago": ("pago",),
    "fecha": ("fechadepago",),
    "concepto": ("concepto", "estadoactual"),
    "estado": ("gestion", "recuperada"),
}
ADJUSTMENT = "AJUSTE"
# Separators of payment files by extension, the first that occurs in the header line counts.
PAYMENT_SEPARATORS = {
    "csv": (";", "\t", "|", ",", " "),
    "txt": ("\t", "|", ";", ",", " "),
}
SMALLEST_PAYMENT = 0.01
ROWS_PER_PAYMENT_FILE = 1_040_000

# --- fixed values: header sets of the vendor reports ------------------------------------------
BOT_BASE = ("campaña", "fecha_estado_final", "rut", "telefono", "estado_llamada", "tiempo_llamada")
BOT_BASE_BY_CALL = ("campaña", "fecha_llamada", "rut", "telefono", "estado_llamada", "tiempo_llamada")
VENDOR_LAYOUTS = (
    ("bot_benefits", BOT_BASE + ("nombre", "apellido", "desea_beneficios")),
    ("bot_agreement", BOT_BASE + ("id base", "fecha_acuerdo", "fecha_plazo")),
    ("bot_titular", BOT_BASE + ("marca",)),
    ("bot_base", BOT_BASE),
    ("bot_base", BOT_BASE_BY_CALL),
    ("sms_1", (
        "respuesta doble via", "fecha de creacion", "enviados", "registros", "total",
        "fecha de finalización", "codigo estado", "doble via", "id", "flash", "créditos", "estado",
        "aperuras landing", "bulk", "nombre de la campaña", "tipo de campaña", "tipo servicio",
        "codigo servicio", "errados", "id usuario", "progresivo", "fecha de inicio", "periodo",
        "nombre de usuario", "país",
    )),
    ("ivr_1", (
        "estado", "nombre_campana", "id", "registros", "tipo_campana", "ejecutados_pct",
        "ejecutados", "ult_llamada", "archivo", "sin_respuesta", "fecha_inicio",
        "repasos_asignados", "repasos_ejecutados", "fecha_fin", "segundos", "satisfactorios",
        "colgados", "pendientes", "usuario", "fecha_creacion", "audio", "id_usuario",
        "sin_contacto",
    )),
    ("email", (
        "id cuenta", "cuenta", "campaña", "asunto", "fecha de envío", "estado campaña",
        "total cargados", "procesados", "no procesados", "no enviados", "% no enviados",
        "entregados", "% entregados", "abiertos", "% abiertos", "clics", "% clics", "diferidos",
        "% diferidos", "spam", "% spam", "dados de baja", "% dados de baja", "rebote fuerte",
        "% rebote fuerte", "rebote suave", "% rebote suave", "clics unicos", "% clics unicos",
        "aperturas unicas", "% aperturas unicas", "rechazados", "% rechazados", "adjuntos",
        "adjuntos genericos", "adjuntos personsalizados", "fecha de creación", "remitente",
        "enviado por", "id campaña", "correo de aprobación", "fecha de cancelación",
        "cancelado por", "descripción", "etiquetas", "cc", "cco",
    )),
    ("sms_2", (
        "packageid", "fecha creacion", "fecha programado", "cliente", "usuario",
        "total registros cargados", "total mensajes programados", "total mensajes erroneos",
        "total mensajes enviados", "es premium", "es flash", "campaña", "mensaje",
        "tipo de envío", "descripción", "total de clicks", "click unicos", "total restricciones",
        "total procesados", "destinatario restringido",
    )),
    ("ivr_2", (
        "dst party id", "account name", "costo", "país del código", "src party id",
        "subscriber name", "tarifa", "tiempo facturado", "nombre del código", "leg id",
        "connect time",
    )),
)
# Time, group, value and cost column of each vendor's reports.
VENDOR_COLUMNS = {
    "sms_1": ("fecha de inicio", "nombre de usuario", "enviados", None),
    "ivr_1": ("fecha_inicio", "nombre_campana", "segundos", None),
    "ivr_2": ("connect time", "account name", "tiempo facturado", "costo"),
    "email": ("fecha de envío", "remitente", "procesados", None),
    "sms_2": ("fecha programado", "campaña", "total procesados", None),
}
UNKNOWN_LAYOUT = "unknown"
GROUPING_WORDS = "estandar|personalizado"
MACHINE_ANSWER = "contestadora"

BOT_REPORT_COLUMNS = (
    "campaña", "fecha_llamada", "rut", "nombre", "apellido", "telefono", "estado_llamada",
    "desea_beneficios", "tiempo_llamada",
)
BOT_REPORT_LAYOUTS = (
    ("campaña", "fecha_estado_final", "rut", "nombre", "apellido", "telefono", "estado_llamada",
     "desea_beneficios", "tiempo_llamada"),
    ("campaña", "fecha_llamada", "rut", "nombre", "apellido", "telefono", "desea_beneficios",
     "estado_llamada", "tiempo_llamada"),
    ("campaña", "fecha_llamada", "rut", "nombre", "apellido", "telefono", "estado_llamada",
     "tiempo_llamada"),
    BOT_REPORT_COLUMNS,
)

# --- fixed values: campaign keywords, later rules win -------------------------------------------
CAMPAIGN_KEYWORDS = (
    ("pash", ("pash",)),
    ("gmac", ("gm", "insoluto", "chevrolet")),
    ("claro", (
        "210", "0_", "rr", "ascard", "bscs", "prechurn", "churn", "potencial", "prepotencial",
        "descuento", "esp", "30_", "prees", "preord",
    )),
    ("puntored", ("puntored",)),
    ("crediveci", ("crediveci",)),
    ("yadinero", ("dinero",)),
    ("qnt", ("qnt",)),
    ("habi", ("habi",)),
    ("payjoy", ("payjoy", "pay joy")),
)
# Keywords of one group that differ by vendor.
CLARO_KEYWORDS = {
    "ivr_2": (
        "210", "0_30", "rr", "ascard", "bscs", "prechurn", "churn", "potencial", "prepotencial",
        "descuento", "esp", "30_", "prees", "preord",
    ),
    "sms_2": (
        "210", "_30", "rr", "ascard", "bscs", "prechurn", "churn", "potencial", "prepotencial",
        "especial",
    ),
}
VENDOR_KEYWORDS = {"ivr_1": CAMPAIGN_KEYWORDS} | {
    vendor: tuple((group, words if group == "claro" else given) for group, given in CAMPAIGN_KEYWORDS)
    for vendor, words in CLARO_KEYWORDS.items()
}
UNIFIED_GROUPS = (
    ("claro", "CLARO"),
    ("chevrolet|gm|insoluto", "GMAC"),
    ("qnt", "QNT"),
    ("dinero", "YA DINERO"),
    ("pash|credito", "PASH"),
    ("puntored", "PUNTORED"),
    ("habi", "HABI"),
    ("crediveci", "CREDIVECI"),
    ("payjoy", "PAYJOY"),
)
LIST_CAMPAIGNS = {"4251": "GMAC", "4181": "PASH"}
DEFAULT_LIST_CAMPAIGN = "CLARO"

# --- fixed values: brand payment file --------------------------------------------------------------
BRAND_PAYMENT_COLUMNS = (
    "Marca", "CRM Origen", "CUENTA NEXT", "SALDO", "RANGO", "MULTIPRODUCTO", "FECHA INGRESO",
    "FECHA SALIDA", "VALOR PAGO", "VALOR PAGO REAL", "FECHA ULT PAGO", "DESCUENTO",
    "EXCLUSION DCTO", "LIQUIDACION", "TIPO DE PAGO", "PAGO", "CLASIFICACION",
)

# --- fixed values: agent time report -------------------------------------------------------------------
AGENT_TIME_COLUMNS = (
    "Usuario", "identificación", "LLAMADAS", "HORA", "tiempo de inicio de sesión", "ESPERA",
    "ESPERE%", "CHARLA", "CHARLA TIEMPO%", "DISPO", "DISPOTIME%", "Pausa", "pausetime%", "DEAD",
    "TIEMPO MUERTO%", "CLIENTE", "CONNECTED", "ALMUER", "BANO", "BKAM", "BKPM", "LAGGED", "LOGIN",
    "PAUACT", "RETROA", "REUNIO", "VISIBLE", "HIDDEN",
)
AGENT_TIME_RENAMES = {
    "BKAM": "BREAK",
    "BKPM": "BREAKP",
    "PAUACT": "PACTIV",
    "REUNIO": "REU",
    "identificación": "identificacion",
    "tiempo de inicio de sesión": "tiempo de inicio de sesion",
}


# Columns of the message dashboard and where they come from.
DASHBOARD_TARGET = (
    "Identificacion", "Cuenta_Next", "Cuenta", "Fecha_Asignacion", "Edad_Mora", "CRM", "Saldo_Asignado", "Segmento",
    "Form_Moneda", "Nombre_Completo", "Rango", "Referencia", "Dato_Contacto", "Hora_Envio", "Hora_Real",
    "Fecha_Envio", "marca2", "DCTO", "DEUDA_REAL", "FLP", "PRODUCTO", "fechapromesa", "TIPO_PAGO", "MEJOR PERFIL",
    "DIAS DE MORA", "RANKING STATUS", "CANTIDAD SERVICIOS", "NOMBRE CORTO", "TIPO BASE", "SMS", "REQUEST ID",
)
DASHBOARD_SOURCES = {
    "Identificacion": "IDENTIFICACION",
    "Edad_Mora": "MORA",
    "Form_Moneda": "VALOR_PAGO",
    "Nombre_Completo": "NOMBRE_CORREGIDO",
    "Rango": "RANGO_DEUDA",
    "Referencia": "REFERENCIA",
    "Dato_Contacto": "TELEFONOS",
    "Hora_Real": "HORA_EJECUCION",
    "Fecha_Envio": "FECHA_EJECUCION",
    "marca2": "MORA",
    "DCTO": "DESCUENTO",
    "FLP": "FLP",
    "PRODUCTO": "PRODUCTO",
    "TIPO_PAGO": "TIPO_PAGO",
    "MEJOR PERFIL": "MEJOR_PERFIL",
    "DIAS DE MORA": "DIASMORA",
    "NOMBRE CORTO": "NOMBRE_CORTO",
    "TIPO BASE": "TIPO_DE_BASE",
    "SMS": "OUTPUT_DATA",
    "REQUEST ID": "REQUEST_ID",
}


# Account columns that the text message base carries along.
SMS_ACCOUNT_COLUMNS = (
    "fecha_asignacion", "customer_type_id", "fecha_vencimiento", "fechapromesa", "mejorperfil_mes", "cant_servicios",
)


# Output columns of the voice bases.
IVR_LAYOUTS = {
    "standard": {
        "Dato_Contacto": "TELEFONO 1",
        "identificacion": "DOCUMENTO",
        "cuenta": "IDENTI",
        "Mod_init_cta": "MONTO_INICIAL",
        "origen": "CRM_ORIGEN",
        "marca": "MARCA_ASIGNADA",
        "dias": "DIAS DE MORA",
        "linea": "Tipo de Linea",
        "corto": "NOMBRE CORTO",
        "descuento": "DESCUENTO",
        "tipo_pago": "tipo_pago",
        "Tipo Base": "TIPO BASE",
    },
    "mailed": {
        "identificacion": "identificacion",
        "corto": "nombre",
        "Dato_Contacto": "telefono",
        "cuenta": "cuenta",
        "Mod_init_cta": "saldo",
        "origen": "CRM",
        "marca": "MARCA",
        "dias": "DIAS DE MORA",
        "linea": "Tipo de Linea",
        "estado_ranking": "RANKING STATUS",
        "Tipo Base": "TIPO BASE",
    },
}


# Columns of the partner files.
PARTNER_EMAILS = ("email1", "email2", "email3", "email4", "email5")
PARTNER_FILES = {
    "slots_with_dialed": {
        "account": "id_usuario", "document": "identificacion", "name": "titular", "price": "por_pagar_total",
        "entry_date": "fecha_ingreso",
        "contacts": (*[f"celular{i}" for i in range(1, 11)], *[f"fijo{i}" for i in range(1, 5)], "numeromarcado", "celular"),
        "emails": PARTNER_EMAILS,
    },
    "slots_mobile": {
        "account": "cuenta", "document": "identificacion", "name": "nombrecompleto", "price": "saldo_total",
        "entry_date": "fecha_ingreso",
        "contacts": (*[f"celular{i}" for i in range(1, 11)], *[f"fijo{i}" for i in range(1, 5)]),
        "emails": PARTNER_EMAILS,
    },
    "slots_network": {
        "account": "cuenta", "document": "identificacion", "name": "nombrecompleto", "price": "valor_a_pagar",
        "entry_date": "fecha_ingreso",
        "contacts": (*[f"celular{i}" for i in range(1, 11)], *[f"fijo{i}" for i in range(1, 4)]),
        "emails": PARTNER_EMAILS,
    },
    "list_cell_comma": {
        "account": "cuenta", "document": "identificacion", "name": "nombrecompleto", "price": "saldo_total",
        "list_cell": "telefonos", "list_separator": ",",
    },
    "list_cell_pipe": {
        "account": "account", "document": "identifitation", "name": "nombrecompleto", "price": "pago_minimo",
        "entry_date": "fechagestion", "contacts": ("telefono",), "list_cell": "telefonos",
        "email_cell": "correos_agregados", "profiles": ("mejorperfil", "ultimoperfil"), "unpaid_column": "valor_pago",
    },
    "repeated_headers": {
        "account": "cuenta", "document": "identificacion", "name": "nombrecompleto", "price": "valor_a_pagar",
        "entry_date": "fecha_ingreso", "contacts": ("numeromarcado", "celular", "celular_1", "segundo_celular"),
        "emails": PARTNER_EMAILS, "profiles": ("mejorperfil", "ultimoperfil", "mejorperfil_mes", "ultimoperfil_mes"),
    },
}


# Columns of the wide monthly dataset by the prefix of their group.
WIDE_GROUPS = {
    "BG_": ("CUENTA NEXT", "DOCUMENTO", "MARCA", "CRM", "SALDO", "FECHA INGRESO", "FECHA VENCIMIENTO"),
    "DS_VAR_": (
        "MULTIPRODUCTO", "MULTIMORA", "MULTICUENTA", "RANGO DEUDA", "RANGO CON DESCUENTO", "TIPO DE DOCUMENTO",
        "DEPARTAMENTO", "RANGO DE DIAS ASIGNADA", "RANGO DE DIAS RETIRADA", "RANGO DE DIAS MORA",
        "FILTRO REPORTE GESTION", "FILTRO REFERENCIA", "FILTRO DEMOGRAFICOS", "CANTIDAD DEMOGRAFICOS",
        "CANTIDAD MOVILES", "CANTIDAD FIJOS", "CANTIDAD EMAILS", "contacto directo", "contacto indirecto",
        "no contacto", "CUSTOMER TYPE", "DIAS ASIGNADA", "DIAS RETIRADA", "DIAS MORA",
    ),
    "AD_": (
        "ESTADO CUENTA", "FILTRO DESCUENTO", "FILTRO PAGOS SIN APLICAR", "FILTRO NO GESTION", "EXCLUSION CUENTA",
        "EXCLUSION DOCUMENTO", "ESTADO RANKING", "SERVICIOS RANKING", "RECUENTO PAGOS", "RECUENTO NO GESTION",
        "Toques por SMS", "Toques por EMAIL", "Toques por BOT", "Toques por IVR",
    ),
    "FLT_": (
        *[f"Dia_{i}" for i in range(1, 32)], *[f"phone{i}" for i in range(1, 21)], *[f"email{i}" for i in range(1, 6)],
    ),
}
