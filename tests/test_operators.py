"""Invariants of the row-shape and relational operators."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.operators import aggregates, dedup, joins, regions, reshape
from dunlake.operators import calendar as cal
from dunlake.operators import projection as p
from dunlake.operators.search import search, search_summary


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def brute_calendar(days, last):
    """Day by day: presence, then gaps before a later presence, then one day after the last."""
    result = []
    for day in range(1, 32):
        if day in days:
            result.append("Asignada")
        elif min(days) < day and any(d > day for d in days):
            result.append("Sin reasignar")
        elif day - 1 == max(days) and day <= last:
            result.append("Retirada")
        else:
            result.append("")
    return result


def test_calendar_against_brute_force(spark):
    rng = random.Random(7)
    keys = {f"k{i}": set(rng.sample(range(1, 32), rng.randint(1, 31))) for i in range(60)}
    keys |= {"one": {1}, "end": {31}, "gap": {1, 31}, "all": set(range(1, 32)), "before_end": {29, 30}}
    last = max(max(days) for days in keys.values())
    df = spark.createDataFrame([(k, d) for k, days in keys.items() for d in days for _ in range(2)], "k string, d int")
    result = {r["k"]: list(r["dias"]) for r in cal.calendar(df, "k", "d").collect()}
    assert result == {k: brute_calendar(days, last) for k, days in keys.items()}


def test_calendar_summary(spark):
    df = spark.createDataFrame([("a", 2), ("a", 4), ("b", 10)], "k string, d int")
    summary = cal.calendar_summary(cal.calendar(df, "k", "d"), "1/2024")
    found = rows(summary, "k", "dias_asignada", "dias_retirada", "fecha_ingreso", "fecha_retiro", "estado_cuenta")
    assert found == [("a", 2, 2, "2/1/2024", "5/1/2024", "Recuperada"), ("b", 1, 0, "10/1/2024", "-", "En gestion")]


def test_dedup_is_deterministic_and_unique(spark):
    data = [(i % 5, i, f"v{i % 3}") for i in range(100)]
    results = []
    for partitions in (1, 7):
        df = spark.createDataFrame(data, "k int, o int, v string").repartition(partitions)
        results.append(rows(dedup.dedup(df, ["k"], [F.col("o").desc()]), "k", "o", "v"))
    assert results[0] == results[1] == [(k, 95 + k, f"v{(95 + k) % 3}") for k in range(5)]


@pytest.mark.parametrize("count,parts", [(10, 3), (2, 5), (9, 3), (0, 2), (101, 10)])
def test_split_rows_covers_every_row_once(spark, count, parts):
    df = spark.range(count).repartition(4)
    found = rows(dedup.split_rows(df, parts, ["id"]), "id", "parte")
    size = count // parts
    assert found == [(i, parts - 1 if count < parts else min(parts - 1, i // size)) for i in range(count)]


@pytest.mark.parametrize("heavy_rows", [0, 1, 100, 10**6])
def test_unbounded_rank_with_a_hot_key(spark, heavy_rows):
    data = [("hot", i) for i in range(500)] + [(f"k{i % 20}", i) for i in range(200)] + [(None, 1), (None, 2), ("one", 1)]
    df = spark.createDataFrame(data, "`the.key` string, v int").repartition(6)
    found = dedup.ranked(df, ["the.key"], ["v"], "r", heavy_rows=heavy_rows).collect()
    expected = {}
    for key in {k for k, _ in data}:
        for rank, value in enumerate(sorted(v for k, v in data if k == key), 1):
            expected[(key, value)] = rank
    assert {(r["the.key"], r["v"]): r["r"] for r in found} == expected and len(found) == len(data)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unbounded_rank_of_small_keys_is_one_shuffle(spark, tmp_path):
    spark.range(1000).selectExpr("id % 70 AS k", "id AS v").write.parquet(str(tmp_path / "t"))
    plan = plan_of(dedup.ranked(spark.read.parquet(str(tmp_path / "t")), ["k"], ["v"], "r"))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "rangepartitioning" not in plan


def test_group_stats_of_hot_keys(spark):
    """Half of the rows have one key, a quarter null: right sums, and rows dealt evenly behind the join."""
    n = 40_000
    data = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 4 = 1 THEN NULL ELSE concat('k', id) END AS `the.key`", "id AS v", "map('a', 1) AS m")
    stats = {"s": F.sum("v"), "n": F.count("*"), "none": F.max(F.lit(None).cast("int"))}
    result = aggregates.with_group_stats(data.repartition(5), ["the.key"], **stats)
    assert result.columns == ["the.key", "v", "m", "s", "n", "none"]
    expected = {"hot": (sum(range(0, n, 2)), n // 2, None), None: (sum(range(1, n, 4)), n // 4, None)}
    found = result.groupBy("`the.key`").agg(F.count("*").alias("rows"), F.min("s").alias("low"), F.max("s").alias("high"), F.max("n").alias("n"), F.max("none").alias("none"))
    for r in found.collect():
        total, size, none = expected.get(r["the.key"]) or (int(r["the.key"][1:]), 1, None)
        assert (r.low, r.high, r.n, r.rows, r.none) == (total, total, size, size, none)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        whole = aggregates.with_group_stats(data.repartition(5), ["the.key"], **stats)
        sizes = sorted(r["count"] for r in whole.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_pivot_slots(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "w")], "k string, o int, v string")
    assert rows(reshape.pivot_slots(df, ["k"], ["o"], "v", 2, "s"), "k", "s1", "s2") == [("a", "x", "y"), ("b", "w", "")]


def test_items_per_key_spreads_large_keys_without_loss(spark):
    df = spark.createDataFrame([("big", i) for i in range(50)] + [("small", 1), ("small", 1)], "k string, i int")
    found = reshape.items_per_key(df, "k", "i", "items", limit=10).collect()
    parts = [r["items"].split(";") for r in found if r["k"] == "big"]
    assert len(parts) > 1 and sorted(int(i) for part in parts for i in part) == list(range(50))
    assert [(r["parte"], r["items"]) for r in found if r["k"] == "small"] == [(0, "1")]


def test_enrich_keeps_the_row_count(spark):
    base = spark.createDataFrame([(1, "d1"), (1, "d0"), (2, "d2"), (3, None)], "k int, d string")
    extra = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    documents = spark.createDataFrame([("d2", 9), ("d2", 8)], "d string, w int")
    result = joins.enrich(base, "k", ["d"], [(extra, "k", ["v"]), (documents, "d", ["w"])])
    assert sorted((r["k"], r["d"] or "", r["v"] or "", r["w"] or 0) for r in result.collect()) == [
        (1, "d0", "x", 0), (2, "d2", "z", 8), (3, "", "", 0),
    ]


def test_match_misses_and_hits_are_disjoint(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1,), (3,), (3,)], "k int")
    assert rows(joins.match(left, right, ["k"]), "k") == [(1,), (3,)]
    assert rows(joins.match(left, right, ["k"], want=False), "k") == [(2,)]


def test_group_stats_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    assert sorted((r["v"], r["n"]) for r in aggregates.with_group_stats(df, ["k"], n=F.count("*")).collect()) == [
        (1, 2), (2, 2), (3, 2), (4, 2),
    ]


def test_split_valid_parts_cover_the_input(spark):
    data = [("80", "x"), ("89", None), ("90", "x"), ("abc", "x"), (None, "x"), ("85", "y")]
    good, errors = p.split_valid(spark.createDataFrame(data, "t string, f string"), "t", ["f"])
    assert rows(good, "t") == [("80",), ("85",)]
    assert good.count() + errors.count() == len(data)


def test_regions_follow_rule_priority(spark):
    rules = spark.createDataFrame(
        [(2, "SAN JOSE", "META"), (1, "SAN JOSE DEL", "GUAVIARE"), (3, "NADA", "INVENTADO")],
        "prioridad int, pueblo string, departamento string",
    )
    places = ["San Jose del Guaviare/X", "san jose", "", None, "HUILA", "nada"]
    df = spark.createDataFrame([(x,) for x in places], "c string")
    found = [(r["c"], r["DEPARTAMENTO"]) for r in regions.map_region(df, "c", rules).collect()]
    assert sorted(found, key=str) == sorted(
        [("San Jose del Guaviare/X", "GUAVIARE"), ("san jose", "META"), ("", "VACIO"), (None, "VACIO"),
         ("HUILA", "HUILA"), ("nada", "NO IDENTIFICADO")], key=str,
    )


def test_search_lists_terms_without_hits(spark):
    df = spark.createDataFrame([("abc", 12), (None, 23)], "a string, n int")
    hits = search(df, ["b", "2", "zz"])
    assert rows(hits, "n", "Dato_Buscado") == [(12, "2"), (12, "b"), (23, "2")]
    summary = rows(search_summary(hits, ["b", "2", "zz"]), "Dato_Buscado", "Encontrado", "Total_Coincidencias")
    assert summary == [("2", "SI", 2), ("b", "SI", 1), ("zz", "NO", 0)]


def test_touch_matrix(spark):
    schema = "cuenta_real string, cuenta_sin_punto string, marca string, cantidad bigint"
    sms = spark.createDataFrame([("1.0", "1", "Churn", 2), ("2.0", "2", "raro", 1)], schema)
    bot = spark.createDataFrame([("1.0", "1", "Churn", 5), ("3.0", "3", None, 1), ("3.0", "3", "30", 4)], schema)
    found = rows(aggregates.touch_matrix({"sms": sms, "bot": bot}), "cuenta_sin_punto", "marca", "toques_sms", "toques_bot")
    assert found == [("1", "churn", 2, 5), ("3", "30", 0, 4)]


def test_retire_flag_only_touches_ranked_special_brands(spark):
    none = fixed.NO_RANKING
    df = spark.createDataFrame(
        [("churn", none), ("churn", "GESTIONAR"), ("potencial", none), ("30", none), ("30", "X")], "m string, e string"
    )
    assert rows(aggregates.brand_retire_flag(df, "m", "e"), "m", "e") == sorted(
        [("churn", "RETIRAR"), ("churn", "GESTIONAR"), ("potencial", none), ("30", none), ("30", "X")]
    )


def test_agent_results_harmonise_headers(spark):
    money = spark.createDataFrame([("d", "g", "a", 1, 2)], "`Día` string, `Tipologia Grupo` string, Agente string, Acuerdos int, Pagos int")
    services = spark.createDataFrame([("d", "g", "b", 3)], "`Día` string, `Tipologia Grupo` string, Agente string, `Servicios Gestionados` int")
    found = rows(aggregates.agent_results([money, services]), "Agente", "Productividad", "Tipologia")
    assert found == [("a", 1, "Recaudo"), ("b", 3, "Cuentas")]


def test_open_payments_and_contact_day(spark):
    df = spark.createDataFrame([("",), ("Pago Parcial",), ("Sin Pago",), (None,), ("Total",)], "t string")
    assert df.filter(p.is_open_payment("t")).count() == 4
    assert df.filter(p.is_open_payment("t", allow_partial=False)).count() == 3
    days = spark.createDataFrame([("2024-01-01",), (None,), ("",), ("2024-01-02",)], "d string")
    assert days.filter(p.not_contacted_on("d", date(2024, 1, 1))).count() == 3


def test_chosen_brands():
    assert joins.chosen_brands(["0 - 30", "Potencial", "30"]) == ["0", "30", "potencial", "potencial a castigar"]
    assert "apple manual" in joins.chosen_brands(["Todo"]) and "castigo" not in joins.chosen_brands(["Todo - Castigo"])
