"""Joins and unions J1-J9, U4 over the tables and stand-in views."""

from __future__ import annotations

from pyspark.sql import functions as F

from dunlake.catalog import sqltext as q
from dunlake.catalog.registry import query
from dunlake.functions import contacts
from dunlake.functions import fixed_values as fixed
from dunlake.operators import aggregates, joins, reshape
from dunlake.operators.dedup import dedup
from dunlake.operators.unions import upsert_contacts


@query(
    "j1_enrich",
    """
    WITH una AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1),
    pieza AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1)
    SELECT o_orderkey, o_custkey, u.l_partkey AS primera_pieza, pieza.l_extendedprice AS mayor, c_name, c_mktsegment
    FROM orders LEFT JOIN una u ON u.l_orderkey = o_orderkey LEFT JOIN pieza ON pieza.l_orderkey = o_orderkey
    LEFT JOIN customer ON c_custkey = o_custkey
    """,
)
def enriched(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    first = lines.select("o_orderkey", "l_linenumber", F.col("l_partkey").alias("primera_pieza"), "l_suppkey", "l_extendedprice")
    largest = lines.select(
        "o_orderkey", F.col("l_extendedprice").alias("mayor"), F.col("l_linenumber").alias("linea"),
        F.col("l_partkey").alias("pieza"), F.col("l_suppkey").alias("proveedor"),
    )
    clients = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    result = joins.enrich(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
        "o_orderkey",
        ["o_custkey", "o_totalprice"],
        [
            (first, "o_orderkey", ["l_linenumber", "primera_pieza", "l_suppkey", "l_extendedprice"]),
            (largest, "o_orderkey", [F.col("mayor").desc(), "linea", "pieza", "proveedor"]),
            (clients, "o_custkey", ["c_name"]),
        ],
    )
    return result.select("o_orderkey", "o_custkey", "primera_pieza", "mayor", "c_name", "c_mktsegment")


TOUCH_COUNT_SQL = (
    "SELECT cuenta AS cuenta_sin_punto, cuenta || '.0' AS cuenta_real, marca, canal, CAST(count(*) AS BIGINT) AS cantidad "
    "FROM contactos GROUP BY cuenta, marca, canal"
)
_CHANNELS = ("click", "error", "view", "purchase")
_SUMS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN canal = '{c}' THEN cantidad END), 0) AS BIGINT) AS toques_{c}" for c in _CHANNELS
)


def channel_counts(t):
    counted = t.contactos.groupBy("cuenta", "marca", "canal").agg(F.count("*").alias("cantidad"))
    rows = counted.select(
        F.col("cuenta").alias("cuenta_sin_punto"), F.concat("cuenta", F.lit(".0")).alias("cuenta_real"), "marca", "canal", "cantidad"
    )
    return {channel: rows.filter(F.col("canal") == channel) for channel in _CHANNELS}


@query(
    "j2_touch_matrix",
    f"""
    WITH toques AS ({TOUCH_COUNT_SQL}), anchas AS (SELECT cuenta_sin_punto, cuenta_real, marca, {_SUMS} FROM toques
      WHERE canal IN {q.in_list(_CHANNELS)} GROUP BY 1, 2, 3),
    una AS (SELECT * FROM anchas QUALIFY row_number() OVER (PARTITION BY cuenta_sin_punto ORDER BY cuenta_real, marca) = 1)
    SELECT * REPLACE (lower(marca) AS marca) FROM una WHERE lower(marca) IN {q.in_list(fixed.TOUCH_BRANDS)}
    """,
)
def touches(t):
    return aggregates.touch_matrix(channel_counts(t))




@query(
    "j3_merge_contacts",
    """
    WITH f AS (SELECT account, document, min(demographic) AS phone1 FROM lago WHERE NOT contains(demographic, '@') GROUP BY 1, 2),
    e AS (SELECT account, document, min(demographic) AS email1 FROM nuevos WHERE contains(demographic, '@') GROUP BY 1, 2)
    SELECT coalesce(f.account, e.account) AS account, coalesce(f.document, e.document) AS document, phone1, email1
    FROM f FULL JOIN e ON f.account = e.account
    """,
)
def merged_contacts(t):
    phones = t.lago.filter(~F.contains("demographic", F.lit("@"))).groupBy("account", "document")
    emails = t.nuevos.filter(F.contains("demographic", F.lit("@"))).groupBy("account", "document")
    return joins.merge_contacts(
        phones.agg(F.min("demographic").alias("phone1")),
        emails.agg(F.min("demographic").alias("email1")),
        "account",
        "document",
    )


@query(
    "j4_apply_discount",
    """
    SELECT orden, cuenta2, coalesce(p.porcentaje, '0') AS porcentaje FROM base LEFT JOIN
      (SELECT CAST(l_orderkey AS VARCHAR) || '-' AS llave, CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) || '%' AS porcentaje
       FROM lineitem) p ON p.llave = cuenta2
    """,
)
def discounts(t):
    table = t.lineitem.select(
        F.col("l_orderkey").alias("codigo"),
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("porcentaje"),
    )
    joined = joins.apply_discount(t.base, table, "cuenta2", "codigo", "porcentaje")
    return joined.select("orden", "cuenta2", "porcentaje")


_CALLS = "SELECT DISTINCT telefono || cuenta AS llave, telefono, cuenta FROM contactos WHERE estado IN ('AB', 'NA', 'DROP')"
_KEYS = "SELECT DISTINCT telefono || cuenta AS llave FROM contactos WHERE canal = 'view'"


@query(
    "j5_match",
    f"""
    SELECT true AS cruza, * FROM ({_CALLS}) WHERE llave IN (SELECT llave FROM ({_KEYS}))
    UNION ALL SELECT false, * FROM ({_CALLS}) WHERE llave NOT IN (SELECT llave FROM ({_KEYS}))
    """,
)
def matches(t):
    keyed = t.contactos.withColumn("llave", F.concat("telefono", "cuenta"))
    calls = keyed.filter(F.col("estado").isin("AB", "NA", "DROP")).select("llave", "telefono", "cuenta")
    known = keyed.filter("canal = 'view'").select("llave")
    found = joins.match(calls, known, ["llave"]).withColumn("cruza", F.lit(True))
    missed = joins.match(calls, known, ["llave"], want=False).withColumn("cruza", F.lit(False))
    return found.unionByName(missed)


@query(
    "j6_lookup_contacts",
    """
    WITH d AS (SELECT DISTINCT identificacion AS document FROM base), l AS (SELECT * FROM lago)
    SELECT d.document, l.account, l.demographic FROM d JOIN l ON d.document = l.document
    UNION ALL SELECT document, NULL, NULL FROM d WHERE document NOT IN (SELECT document FROM l)
    """,
)
def looked_up(t):
    documents = t.base.select(F.col("identificacion").alias("document"))
    found = joins.lookup_contacts(documents, t.lago, "document")
    return found.unionByName(joins.lookup_contacts(documents, t.lago, "document", want=False), allowMissingColumns=True)


@query(
    "j7_new_only",
    """
    SELECT DISTINCT account, demographic FROM nuevos n WHERE NOT EXISTS (SELECT 1 FROM lago l WHERE l.account = n.account
      AND l.demographic = n.demographic)
    """,
)
def new_contacts(t):
    return joins.new_only(t.nuevos.select("account", "demographic").distinct(), t.lago, ["account", "demographic"])


@query(
    "j8_group_stat",
    """
    SELECT orden, identificacion, CAST(count(*) OVER w AS BIGINT) AS cuentas, n AS origenes FROM base JOIN
      (SELECT identificacion AS i, count(DISTINCT marca) AS n FROM base GROUP BY 1) ON i = identificacion
    WINDOW w AS (PARTITION BY identificacion)
    """,
)
def group_stats(t):
    rows = t.base.select("orden", "identificacion", "marca")
    return aggregates.with_group_stats(
        rows, ["identificacion"], cuentas=F.count("*"), origenes=F.count_distinct("marca")
    ).drop("marca")


@query(
    "j9_first_row_with_slots",
    """
    WITH c AS (SELECT DISTINCT cuenta, identificacion, marca, dato FROM (SELECT cuenta, identificacion, marca, UNNEST([celular1, celular3, celular2]) AS dato
      FROM base) WHERE TRY_CAST(dato AS BIGINT) BETWEEN 3000000009 AND 3599999999),
    r AS (SELECT *, row_number() OVER (PARTITION BY cuenta ORDER BY dato) AS n FROM c)
    SELECT cuenta, min_by(identificacion, n) AS identificacion, min_by(marca, n) AS marca, coalesce(max(CASE WHEN n = 1 THEN dato END), '') AS phone1,
      coalesce(max(CASE WHEN n = 2 THEN dato END), '') AS phone2, coalesce(max(CASE WHEN n = 3 THEN dato END), '') AS phone3 FROM r GROUP BY 1
    """,
)
def first_rows(t):
    slots = F.array("celular1", "celular3", "celular2")
    rows = t.base.select("cuenta", "identificacion", "marca", F.explode(slots).alias("dato"))
    valid = dedup(rows.filter(contacts.contact_filter("dato", "mobile")), ["cuenta", "dato"], ["identificacion", "marca"])
    return reshape.pivot_slots(valid, ["cuenta"], ["dato"], "dato", 3, "phone", kept=["identificacion", "marca"])


@query(
    "u4_upsert_contacts",
    """
    WITH todos AS (SELECT document, account, demographic FROM lago UNION ALL SELECT document, account, demographic FROM nuevos),
    uno AS (SELECT account, demographic, min(document) AS document FROM todos GROUP BY 1, 2)
    SELECT *, CASE WHEN length(demographic) = 10 AND demographic LIKE '6%' THEN 'fijo' WHEN length(demographic) = 10 AND
      demographic LIKE '3%' THEN 'movil' WHEN contains(demographic, '@') THEN 'email' ELSE 'errado' END AS type FROM uno
    """,
)
def upserted(t):
    return upsert_contacts(t.lago, t.nuevos)
