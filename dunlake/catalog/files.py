"""Scans, layouts and sinks: derived tables are written to the work folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.catalog.registry import query
from dunlake.functions import fixed_values as fixed
from dunlake.operators import projection as p
from dunlake.session import new_path
from dunlake.sources import folders, layouts, sinks, text

_COLUMNS = ["orden", "cuenta", "marca", "origen", "descuento", "ciudad"]
_STORED = "CAST(orden AS VARCHAR) AS orden, cuenta, marca, origen, descuento, ciudad"
# A text file does not tell a blank field from a missing one: both are read as null.
_AS_TEXT = _STORED.replace(" ciudad", " nullif(ciudad, '') AS ciudad")


def plain(t) -> DataFrame:
    return t.base.select(*_COLUMNS)


def stage_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "errorifexists", **options: str) -> str:
    df.write.mode(mode).options(header=True, sep=sep, **options).csv(path)
    return path


def stage_lines(df: DataFrame, header: str, path: str) -> str:
    """Text file with a header line on top of the rows' only column."""
    line = df.columns[0]
    head = df.sparkSession.range(1).select(F.lit(header).alias(line), F.lit(0).alias("_at"))
    body = df.withColumn("_at", F.lit(1))
    head.unionByName(body).coalesce(1).select(line).write.text(path)
    return path


@query("s1_text_table", f"SELECT {_AS_TEXT} FROM base")
def text_table(t):
    return text.read_text_table(t.spark, stage_csv(plain(t), new_path(t.spark, "s1")))


@query(
    "s2_dynamic",
    f"SELECT 'parquet' AS formato, {_STORED} FROM base UNION ALL SELECT 'csv' AS formato, {_AS_TEXT} FROM base",
)
def dynamic(t):
    both, only_csv = new_path(t.spark, "s2"), new_path(t.spark, "s2")
    rows = folders.as_text(plain(t))
    rows.write.parquet(f"{both}.parquet")
    stage_csv(rows.limit(0), f"{both}.csv")
    stage_csv(rows, f"{only_csv}.csv")
    first = folders.read_dynamic(t.spark, both).withColumn("formato", F.lit("parquet"))
    return first.unionByName(folders.read_dynamic(t.spark, only_csv).withColumn("formato", F.lit("csv")))


@query(
    "s3_folder_any",
    """
    SELECT CAST(orden AS VARCHAR) AS orden, cuenta, marca, CAST(NULL AS VARCHAR) AS ciudad FROM base WHERE orden % 2 = 0
    UNION ALL SELECT CAST(orden AS VARCHAR), cuenta, NULL, ciudad FROM base WHERE orden % 2 = 1
    """,
)
def folder_any(t):
    folder = new_path(t.spark, "s3")
    stage_csv(plain(t).filter("orden % 2 = 0").select("orden", "cuenta", "marca"), folder)
    plain(t).filter("orden % 2 = 1").select("cuenta", "orden", "ciudad").write.mode("append").parquet(folder)
    return folders.read_folder_any(t.spark, folder)


@query(
    "s4_tree",
    """
    SELECT CAST(orden AS VARCHAR) AS orden, cuenta, marca, CAST(NULL AS VARCHAR) AS plan FROM base WHERE orden % 3 = 0
    UNION ALL SELECT CAST(orden AS VARCHAR), cuenta, NULL, plan FROM base WHERE orden % 3 = 1
    UNION ALL SELECT CAST(orden AS VARCHAR), NULL, marca, NULL FROM base WHERE orden % 3 = 2
    """,
)
def tree(t):
    """Two CSV layouts and a tab-separated one in different subfolders."""
    folder = new_path(t.spark, "s4")
    stage_csv(t.base.filter("orden % 3 = 0").select("orden", "cuenta", "marca"), f"{folder}/a")
    stage_csv(t.base.filter("orden % 3 = 1").select("cuenta", "orden", "plan"), f"{folder}/b/c")
    stage_csv(t.base.filter("orden % 3 = 2").select("orden", "marca"), f"{folder}/d", sep="\t", extension="txt")
    return folders.read_tree(t.spark, folder)


@query(
    "s5_sniffed_separator",
    "SELECT CAST(orden AS VARCHAR) AS orden, cuenta, marca, UNNEST([';', ',', 'tab']) AS separador FROM base",
)
def sniffed(t):
    rows, result = t.base.select("orden", "cuenta", "marca"), None
    for sep, name in ((";", ";"), (",", ","), ("\t", "tab")):
        path = stage_csv(rows, new_path(t.spark, "s5"), sep)
        found = text.sniff_separator(t.spark, path, "payments")
        part = text.read_text_table(t.spark, path, found).withColumn("separador", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "s6_encoding",
    "SELECT orden, nombre, UNNEST(['UTF-8', 'windows-1252', 'ISO-8859-1']) AS codificacion FROM (SELECT CAST(orden AS VARCHAR) AS orden, "
    "'Peña ' || orden || ' ' || ciudad AS nombre FROM base WHERE ciudad <> '')",
)
def encodings(t):
    """The same names in three encodings; a marker byte in other rows decides between the last two."""
    named = t.base.filter("ciudad <> ''").selectExpr("orden", "'Peña ' || orden || ' ' || ciudad AS nombre")
    stored = (("UTF-8", "€"), ("ISO-8859-1", "\x80"), ("ISO-8859-1", "\x81"))
    result = None
    for encoding, marker in stored:
        marks = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("orden"), F.lit(marker).alias("nombre"))
        path = stage_csv(named.unionByName(marks), new_path(t.spark, "s6"), encoding=encoding)
        found = text.detect_encoding(t.spark, path)
        rows = text.read_text_table(t.spark, path, encoding=found).withColumn("codificacion", F.lit(found))
        part = rows.filter("orden <> '-1' OR nombre NOT IN ('€', '\x81')")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "s7_malformed",
    "SELECT CAST(orden AS VARCHAR) AS orden, marca, plan FROM base WHERE orden % 10 NOT IN (3, 4)",
)
def malformed(t):
    lines = t.base.selectExpr(
        "CASE orden % 10 WHEN 3 THEN orden || ';' || marca WHEN 4 THEN orden || ';' || marca || ';' || plan || ';x' "
        "ELSE orden || ';' || marca || ';' || plan END AS line"
    )
    path = stage_lines(lines, "orden;marca;plan", new_path(t.spark, "s7"))
    return text.read_text_table(t.spark, path, malformed="DROPMALFORMED")


@query(
    "s8_positional",
    "SELECT CAST(orden AS VARCHAR) AS cuenta, celular1 AS celular, celular2 AS celular_1, CASE WHEN orden % 4 = 0 THEN NULL ELSE plan END AS plan FROM base",
)
def positional(t):
    lines = t.base.selectExpr(
        "orden || ';' || coalesce(celular1, '') || ';x;' || coalesce(celular2, '') || CASE WHEN orden % 4 = 0 THEN '' ELSE ';' || plan END AS line"
    )
    path = stage_lines(lines, "cuenta;celular;borrar;celular;plan", new_path(t.spark, "s8"))
    return text.read_positional(t.spark, path, drop=[2])


@query(
    "s9_preamble",
    "SELECT CAST(orden AS VARCHAR) AS orden, marca, plan FROM base UNION ALL SELECT 'orden', 'marca', 'plan' FROM base WHERE orden % 10 = 0 "
    "UNION ALL SELECT 'Desde 2001', NULL, NULL FROM base WHERE orden % 10 = 0",
)
def preamble(t):
    # every tenth row repeats the header or a title of the preamble
    lines = t.base.selectExpr("explode(CASE WHEN orden % 10 = 0 THEN array(orden || ',' || marca || ',' || plan, 'orden,marca,plan', 'Desde 2001') "
                              "ELSE array(orden || ',' || marca || ',' || plan) END) AS line")
    path = stage_lines(lines, "Reporte de agentes\nDesde 2001\n\norden,marca,plan", new_path(t.spark, "s9"))
    return text.read_after_preamble(t.spark, path, 3)


@query(
    "s10_assignment",
    'SELECT documento AS "1_", cuenta AS "2_", origen AS "3_", Mod_init_cta AS "9_", nullif(ciudad, \'\') AS "22_", \'Ñandú\' AS "24_" FROM base '
    "WHERE orden % 6 <> 0",
)
def assignment(t):
    given = {"1_": "documento", "2_": "cuenta", "3_": "CASE WHEN orden % 6 = 0 THEN 'OTRO' ELSE origen END",
             "9_": "Mod_init_cta", "22_": "ciudad", "24_": "'Ñandú'"}
    rows = t.base.selectExpr(*[f"{given.get(c, repr(''))} AS `{c}`" for c in text.ASSIGNMENT_COLUMNS])
    path = stage_csv(rows, new_path(t.spark, "s10"), encoding="ISO-8859-1")
    return text.read_assignment(t.spark, path).select("1_", "2_", "3_", "9_", "22_", "24_")


@query(
    "s11_conform",
    "SELECT cuenta, CAST(NULL AS VARCHAR) AS duration, marca, CAST(orden AS BIGINT) AS orden FROM base",
)
def conformed(t):
    return p.conform(plain(t), {"cuenta": "string", "duration": "string", "marca": "string", "orden": "bigint"})


@query(
    "s12_aliases",
    "SELECT cuenta AS obligacion, Mod_init_cta AS valor, fecha_iso AS fecha FROM base WHERE orden % 2 = 0 "
    "UNION ALL SELECT cuenta2, Mod_init_cta, fecha_vencimiento FROM base WHERE orden % 2 = 1",
)
def aliases(t):
    first = t.base.filter("orden % 2 = 0").selectExpr("cuenta AS Cuenta", "Mod_init_cta AS Pago", "fecha_iso AS Fecha")
    second = t.base.filter("orden % 2 = 1").selectExpr(
        "fecha_vencimiento AS FECHA_INGRESO", "cuenta2 AS `Número de Cliente`", "Mod_init_cta AS MONTO"
    )
    parts = [p.resolve_aliases(part, fixed.PAYMENT_ALIASES) for part in (first, second)]
    return parts[0].unionByName(parts[1])


@query(
    "s13_headers",
    'SELECT CAST(orden AS BIGINT) AS "fechadepago", marca AS "casacobro", plan AS "fechadepago_1" FROM base',
)
def headers(t):
    titled = t.base.selectExpr("orden AS ` Fecha de Pago `", "marca AS `Casa Cobro.`", "plan AS `FECHA_de_pago`")
    return p.normalise_headers(titled.withColumnRenamed("FECHA_de_pago", "fecha de pago"), "word")


@query(
    "s14_file_meta",
    "SELECT CAST(orden AS VARCHAR) AS orden, 'marca=' || marca AS carpeta, true AS del_archivo FROM base",
)
def file_meta(t):
    """Name and day of each row's file, held against the listing of the folder."""
    path = new_path(t.spark, "s14")
    t.base.select("orden", "marca").write.partitionBy("marca").options(header=True, sep=";").csv(path)
    listed = t.spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.csv").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("nombre"), F.element_at(F.split("path", "/"), -2).alias("carpeta"),
        F.col("modificationTime").cast("date").alias("dia"),
    )
    rows = folders.with_file_meta(text.read_text_table(t.spark, path, recursiveFileLookup="true"))
    held = rows.select("orden", "archivo", "fecha_archivo", F.col("_metadata.file_path").alias("_path"))
    held = held.withColumn("carpeta", F.url_decode(F.element_at(F.split("_path", "/"), -2)))
    listed = listed.withColumn("carpeta", F.url_decode("carpeta"))
    joined = held.join(listed, (held["archivo"] == listed["nombre"]) & (held["carpeta"] == listed["carpeta"]))
    return joined.select("orden", held["carpeta"], (F.col("fecha_archivo") == F.col("dia")).alias("del_archivo"))


@query(
    "s15_layout",
    "SELECT 'ivr_2' AS formato, CAST(evento AS VARCHAR) AS evento, costo FROM envios "
    "UNION ALL SELECT 'bot_titular', CAST(evento AS VARCHAR), NULL FROM envios",
)
def layout(t):
    """Each table goes to the reader of the layout its headers tell."""
    ivr = dict.fromkeys(dict(fixed.VENDOR_LAYOUTS)["ivr_2"], "''") | {"leg id": "evento", "costo": "costo"}
    bot = dict.fromkeys(fixed.BOT_BASE + ("marca",), "''") | {"rut": "evento"}
    key = {"ivr_2": "leg id", "bot_titular": "rut"}
    parts = []
    for given in (ivr, bot):
        rows = t.envios.selectExpr(*[f"{e} AS `{c}`" for c, e in given.items()])
        kind = layouts.classify_layout(rows.columns)
        cost = F.col("costo") if "costo" in rows.columns else F.lit(None).cast("string")
        parts.append(rows.select(F.lit(kind).alias("formato"), F.col(f"`{key[kind]}`").cast("string").alias("evento"), cost.alias("costo")))
    return parts[0].unionByName(parts[1])


@query(
    "s16_harmonise",
    """
    SELECT campana AS "campaña", momento AS fecha_llamada, CAST(evento AS VARCHAR) AS rut, CAST(NULL AS VARCHAR) AS nombre, CAST(NULL AS VARCHAR) AS apellido,
      valor AS telefono, estado_llamada, CAST(NULL AS VARCHAR) AS desea_beneficios, costo AS tiempo_llamada FROM envios CROSS JOIN (SELECT UNNEST([1, 2]))
    """,
)
def harmonised(t):
    given = {"campaña": "campana", "fecha_estado_final": "momento", "fecha_llamada": "momento", "rut": "CAST(evento AS STRING)",
             "nombre": "'n'", "apellido": "'a'", "telefono": "valor", "estado_llamada": "estado_llamada",
             "desea_beneficios": "'si'", "tiempo_llamada": "costo"}

    def table(columns):
        return t.envios.selectExpr(*[f"{given[c]} AS `{c}`" for c in columns])

    first, _, third, _ = fixed.BOT_REPORT_LAYOUTS
    unknown = t.envios.selectExpr("evento AS otra", "valor AS cosa")
    return layouts.harmonise([table(first), table(third), unknown])


@query(
    "s17_schema_inventory",
    "SELECT 'orden,cuenta,' || marca AS titulos, CAST(1 AS BIGINT) AS archivos FROM base GROUP BY marca",
)
def inventory(t):
    """One file a brand, with the brand in its header."""
    path = new_path(t.spark, "s17")
    rows = t.base.select("marca", F.concat_ws(";", F.col("orden").cast("string"), "cuenta", "plan").alias("line"), F.lit(1).alias("_at"))
    heads = rows.select("marca", F.concat(F.lit("orden;cuenta;"), "marca").alias("line"), F.lit(0).alias("_at")).distinct()
    lines = heads.unionByName(rows).repartition("marca").sortWithinPartitions("marca", "_at").select("marca", "line")
    lines.write.partitionBy("marca").text(path)
    found = folders.schema_inventory(t.spark, path, "*.txt", recursive=True)
    return found.groupBy("titulos").agg(F.count("*").alias("archivos"))


@query(
    "k1_csv_sink",
    f"SELECT {_AS_TEXT}, CAST(4 AS BIGINT) AS archivos FROM base",
)
def csv_sink(t):
    path = new_path(t.spark, "k1")
    sinks.write_csv(plain(t), path, n=4)
    rows = folders.with_file_meta(text.read_text_table(t.spark, path))
    files = rows.agg(F.count_distinct("archivo")).scalar()
    return rows.drop("archivo", "fecha_archivo").withColumn("archivos", files)


@query("k2_parquet_sink", f"SELECT orden, {_STORED.split(', ', 1)[1]} FROM base")
def parquet_sink(t):
    path = new_path(t.spark, "k2")
    sinks.write_parquet(plain(t), path, n=2)
    return t.spark.read.parquet(path)


@query("k3_json_sink", f"SELECT orden, {_STORED.split(', ', 1)[1]} FROM base")
def json_sink(t):
    path = new_path(t.spark, "k3")
    sinks.write_json(plain(t), path)
    return t.spark.read.schema(plain(t).schema).json(path)


@query(
    "k4_convert",
    f"SELECT 'parquet' AS formato, {_AS_TEXT} FROM base UNION ALL SELECT 'json', {_AS_TEXT} FROM base",
)
def converted(t):
    source = stage_csv(plain(t), new_path(t.spark, "k4"))
    parts = []
    for fmt in ("parquet", "json"):
        target = new_path(t.spark, "k4")
        sinks.convert(t.spark, source, target, fmt)
        rows = t.spark.read.format(fmt).load(target)
        parts.append(rows.withColumn("formato", F.lit(fmt)))
    return parts[0].unionByName(parts[1])


@query("k5_split_by_key", "SELECT marca, CAST(orden AS VARCHAR) AS orden, cuenta FROM base")
def split_by_key(t):
    path = new_path(t.spark, "k5")
    sinks.write_by_key(t.base, "marca", path, ["orden", "cuenta", "marca"])
    folder_name = F.regexp_extract(F.col("_metadata.file_path"), "marca=([^/]*)/", 1)
    rows = t.spark.read.options(header=True, sep=";", recursiveFileLookup="true").csv(path)
    return rows.select(F.url_decode(folder_name).alias("marca"), "orden", "cuenta")


@query(
    "k7_bounded_files",
    "SELECT CAST(orden AS VARCHAR) AS orden, true AS acotado FROM base",
)
def bounded_files(t):
    path = new_path(t.spark, "k7")
    sinks.write_payment_files(t.base.select("orden"), path, max_rows=1_000)
    rows = folders.with_file_meta(text.read_text_table(t.spark, path))
    sizes = rows.groupBy("archivo").agg((F.count("*") <= 1_000).alias("acotado"))
    return rows.join(sizes, "archivo").select("orden", "acotado")


@query("u2_merge_files", "SELECT DISTINCT marca, CAST(NULL AS VARCHAR) AS plan, origen FROM base UNION SELECT NULL, plan, origen FROM base")
def merged_files(t):
    """Two layouts with different separators in one folder."""
    folder = new_path(t.spark, "u2")
    stage_csv(t.base.select("marca", "origen"), folder)
    stage_csv(t.base.select("origen", "plan"), folder, sep=",", mode="append")
    return folders.merge_files(t.spark, folder)


@query("u3_merge_by_folder", "SELECT CAST(orden AS VARCHAR) AS orden, marca, lower(origen) AS carpeta FROM base")
def merged_by_folder(t):
    source, target = new_path(t.spark, "u3"), new_path(t.spark, "u3")
    for origin in fixed.ORIGINS:
        stage_csv(t.base.filter(F.col("origen") == origin).select("orden", "marca"), f"{source}/{origin.lower()}")
    sinks.write_by_key(folders.merge_by_folder(t.spark, source), "carpeta", target)
    return t.spark.read.options(header=True, sep=";").csv(target)


@query("a14_file_counts", "SELECT lower(origen) AS carpeta, CAST(count(*) AS BIGINT) AS filas, CAST(1 AS BIGINT) AS archivos FROM base GROUP BY 1")
def counted_files(t):
    """Rows of each file; every folder holds a file of the same name."""
    path = new_path(t.spark, "a14")
    given = plain(t).withColumn("carpeta", F.lower("origen")).repartition("carpeta")
    given.write.partitionBy("carpeta").options(header=True, sep=";").csv(path)
    counts = folders.file_row_counts(t.spark, path)
    folder = F.regexp_extract("archivo", "carpeta=([^/]*)/", 1).alias("carpeta")
    return counts.groupBy(folder).agg(F.sum("filas").alias("filas"), F.count("*").alias("archivos"))
