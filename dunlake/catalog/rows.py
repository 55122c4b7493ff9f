"""Row-shape operators: unpivot, pivot, ranks, dedup and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from dunlake.catalog import sqltext as q
from dunlake.catalog.registry import query
from dunlake.functions import contacts, dates
from dunlake.functions import fixed_values as fixed
from dunlake.operators import dedup as d
from dunlake.operators import reshape
from dunlake.operators.unions import union_all

SLOTS = ["celular1", "celular2", "celular3", "celular4", "fijo1", "fijo2", "min"]
_UNPIVOT = f"SELECT cuenta, identificacion, orden, UNNEST([{', '.join(SLOTS)}]) AS dato FROM base"
_VALID = f"SELECT DISTINCT cuenta, identificacion, dato FROM ({_UNPIVOT}) WHERE {q.valid_phone('dato', low_f=6010000000)}"


def unpivoted(t):
    return reshape.unpivot_slots(t.base.select("cuenta", "identificacion", "orden", *SLOTS), SLOTS, "dato")


def valid_contacts(t):
    rows = unpivoted(t).filter(contacts.contact_filter("dato", landline=fixed.REORDER_LANDLINE_RANGE))
    return d.dedup(rows.repartition("cuenta"), ["cuenta", "dato"], ["orden"])


@query("r1_unpivot_slots", _UNPIVOT)
def slots_to_rows(t):
    return unpivoted(t)


def _slot_sql(keys: str, order: str, n: int, prefix: str, source: str, value: str) -> str:
    cells = ", ".join(f"coalesce(max(CASE WHEN r = {i} THEN {value} END), '') AS {prefix}{i}" for i in range(1, n + 1))
    return (
        f"SELECT {keys}, {cells} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r "
        f"FROM ({source})) WHERE r <= {n} GROUP BY {keys}"
    )


@query("r2_pivot_slots", _slot_sql("cuenta, identificacion", "dato", 5, "phone", _VALID, "dato"))
def rows_to_slots(t):
    return reshape.pivot_slots(valid_contacts(t), ["cuenta", "identificacion"], ["dato"], "dato", 5, "phone")


@query("r2_pivot_documents", _slot_sql("identificacion", "dato, cuenta", 9, "phone", _VALID, "dato"))
def document_slots(t):
    """Nine slots per document; a document's contacts go far beyond the slots."""
    return reshape.pivot_slots(valid_contacts(t), ["identificacion"], ["dato", "cuenta"], "dato", 9, "phone")


@query(
    "r3_explode_list",
    r"""
    SELECT orden, dato FROM (SELECT orden, UNNEST(str_split(regexp_replace(lista_telefonos, '[\[\]{}"\s]', '', 'g'), '|')) AS dato
      FROM base WHERE lista_telefonos IS NOT NULL) WHERE dato <> ''
    """,
)
def exploded_lists(t):
    return reshape.explode_list(t.base, "lista_telefonos", "dato", drop_blank=True).select("orden", "dato")


@query(
    "r4_accounts_per_document",
    f"""
    SELECT identificacion, CAST(0 AS BIGINT) AS parte, string_agg(cuenta, ';' ORDER BY cuenta) AS cuentas FROM
      (SELECT DISTINCT identificacion, replace(cuenta, '-', '') || '_' AS cuenta FROM base WHERE marca IN {q.in_list(fixed.LISTED_BRANDS)})
    GROUP BY 1
    """,
)
def accounts_per_document(t):
    rows = t.base.filter(F.col("marca").isin(*fixed.LISTED_BRANDS))
    account = F.concat(F.translate("cuenta", "-", ""), F.lit("_"))
    return reshape.items_per_key(rows, "identificacion", account, "cuentas")


@query(
    "r5_slot_signature",
    """
    SELECT orden, CASE WHEN coalesce(trim(fijo1), '') = '' THEN '3' WHEN TRY_CAST(fijo1 AS BIGINT) <= 3599999999 THEN '1' ELSE '2' END ||
      CASE WHEN coalesce(trim(celular1), '') = '' THEN '3' WHEN TRY_CAST(celular1 AS BIGINT) <= 3599999999 THEN '1' ELSE '2' END ||
      CASE WHEN coalesce(trim(celular3), '') = '' THEN '3' WHEN TRY_CAST(celular3 AS BIGINT) <= 3599999999 THEN '1' ELSE '2' END AS firma
    FROM base
    """,
)
def signatures(t):
    return t.base.select("orden", contacts.slot_signature(["fijo1", "celular1", "celular3"]).alias("firma"))


def _rank_sql(keys: str, order: str, source: str, columns: str) -> str:
    return f"SELECT {columns}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS orden_contacto FROM ({source})"


@query("w1_rank_contacts", _rank_sql("cuenta, identificacion", "dato", _VALID, "cuenta, identificacion, dato"))
def ranked_contacts(t):
    rows = d.ranked(valid_contacts(t), ["cuenta", "identificacion"], ["dato"], "orden_contacto")
    return rows.select("cuenta", "identificacion", "dato", "orden_contacto")


@query("w2_rank_document_contacts", _rank_sql("identificacion", "cuenta, dato", _VALID, "cuenta, identificacion, dato"))
def ranked_document_contacts(t):
    rows = d.ranked(valid_contacts(t), ["identificacion"], ["cuenta", "dato"], "orden_contacto")
    return rows.select("cuenta", "identificacion", "dato", "orden_contacto")


@query(
    "w3_rank_dates",
    """
    SELECT clave, fecha, row_number() OVER (PARTITION BY clave ORDER BY try_strptime(fecha, '%d/%m/%Y')) AS orden_contacto
    FROM (SELECT DISTINCT clave, fecha FROM presencia)
    """,
)
def ranked_dates(t):
    """Dates of an account in calendar order."""
    days = t.presencia.select("clave", "fecha").distinct().withColumn("_dia", dates.slash_date("fecha"))
    return d.ranked(days, ["clave"], ["_dia", "fecha"], "orden_contacto").drop("_dia")


@query(
    "w4_rank_accounts",
    """
    SELECT identificacion, cuenta, row_number() OVER (PARTITION BY identificacion ORDER BY cuenta) AS orden_contacto FROM base
    """,
)
def ranked_accounts(t):
    """Rank of every account of a document, without a limit on their number."""
    return d.ranked(t.base.select("identificacion", "cuenta"), ["identificacion"], ["cuenta"], "orden_contacto")


@query(
    "d1_distinct",
    "SELECT DISTINCT marca, origen, plan, descuento FROM base",
)
def distinct_rows(t):
    return t.base.select("marca", "origen", "plan", "descuento").distinct()


@query(
    "d2_dedup",
    "SELECT identificacion, orden, cuenta, ciudad FROM base QUALIFY row_number() OVER (PARTITION BY identificacion ORDER BY fecha_iso DESC, orden) = 1",
)
def deduplicated(t):
    """Latest account of each document."""
    latest = d.dedup(t.base, ["identificacion"], [F.col("fecha_iso").desc(), "orden"])
    return latest.select("identificacion", "orden", "cuenta", "ciudad")


@query(
    "d3_top_contacts",
    f"""
    SELECT identificacion, string_agg(dato, ',' ORDER BY dato) AS primeros FROM (SELECT *, row_number() OVER (PARTITION BY identificacion ORDER BY dato) AS r
      FROM (SELECT DISTINCT identificacion, dato FROM ({_VALID}))) WHERE r <= 3 GROUP BY 1
    """,
)
def top_contacts(t):
    pairs = valid_contacts(t).select("identificacion", "dato").distinct()
    top = d.top_rows(pairs, ["identificacion"], ["dato"], 3, "r")
    return top.groupBy("identificacion").agg(F.array_join(F.sort_array(F.collect_list("dato")), ",").alias("primeros"))


@query(
    "d4_ordered",
    "SELECT origen, marca, orden, row_number() OVER (ORDER BY origen, marca DESC, orden) - 1 AS posicion FROM base",
)
def ordered_rows(t):
    """Order of the sorted output; the row number makes it visible in the result."""
    rows = t.base.select("origen", "marca", "orden")
    return d.numbered(rows, ["origen", F.col("marca").desc(), "orden"], "posicion")


@query(
    "k6_split_rows",
    """
    SELECT least(6, rn // (n // 7)) AS parte, CAST(count(*) AS BIGINT) AS filas, min(o_orderkey) AS primera, max(o_orderkey) AS ultima
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)
    GROUP BY 1
    """,
)
def split_ranges(t):
    parts = d.split_rows(t.orders.select("o_orderkey", "o_orderdate"), 7, ["o_orderdate", "o_orderkey"])
    return parts.groupBy("parte").agg(
        F.count("*").alias("filas"), F.min("o_orderkey").alias("primera"), F.max("o_orderkey").alias("ultima")
    )


@query(
    "u1_two_ranges",
    f"SELECT orden, celular1 FROM base WHERE {q.valid_phone('celular1')} UNION ALL SELECT orden, fijo1 FROM base WHERE {q.valid_phone('fijo1')}",
)
def two_ranges(t):
    """Both ranges in one predicate over one scan instead of a union of two filters."""
    rows = t.base.select("orden", F.explode(F.array("celular1", "fijo1")).alias("celular1"))
    return rows.filter(contacts.contact_filter("celular1"))


@query(
    "u2_union_by_name",
    """
    SELECT orden, celular1, CAST(NULL AS VARCHAR) AS fijo1 FROM base UNION SELECT orden, CAST(NULL AS VARCHAR), fijo1 FROM base
    """,
)
def united(t):
    return union_all([t.base.select("orden", "celular1"), t.base.select("fijo1", "orden")]).distinct()


@query(
    "u5_chunk_slots",
    """
    SELECT orden, bloque, t1, t2, t3 FROM (SELECT orden, 1 AS bloque, celular1 AS t1, celular2 AS t2, celular3 AS t3 FROM base
      UNION ALL SELECT orden, 2, celular4, fijo1, fijo2 FROM base UNION ALL SELECT orden, 3, min, NULL, NULL FROM base)
    """,
)
def chunked(t):
    return reshape.chunk_slots(t.base.select("orden", *SLOTS), SLOTS, 3, "t")
