"""Literal rows for cases in which rows once got lost, mixed or rounded away."""

import decimal
from datetime import date

import pytest
from pyspark.sql import functions as F

from dunlake.functions.base import whole
from dunlake.operators.aggregates import VolumeSpec, daily_volume
from dunlake.operators.dedup import ranked
from dunlake.operators.regions import map_region
from dunlake.operators.reshape import items_per_key
from dunlake.plans import payments
from dunlake.sources import folders
from dunlake.sources.text import read_after_preamble


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lines_equal_to_the_preamble_stay(spark, tmp_path):
    write(tmp_path / "f.csv", "Title\n\na,b\n1,2\na,b\nTitle\n\n3,4\n")
    got = [tuple(r) for r in read_after_preamble(spark, str(tmp_path / "f.csv"), 2).collect()]
    assert got == [("1", "2"), ("a", "b"), ("Title", None), (None, None), ("3", "4")]


def test_folders_with_other_column_orders(spark, tmp_path):
    write(tmp_path / "a" / "f.csv", "k;v\n1;x\n")
    write(tmp_path / "b" / "f.csv", "v;k\nz;3\n")
    assert rows(folders.merge_by_folder(spark, str(tmp_path), columns=["k", "v"])) == [("1", "x", "a"), ("3", "z", "b")]


def test_files_of_one_name_count_apart(spark, tmp_path):
    write(tmp_path / "a" / "f.csv", "k\n1\n2\n")
    write(tmp_path / "b" / "f.csv", "k\n3\n")
    counts = folders.file_row_counts(spark, str(tmp_path)).collect()
    assert sorted((r.archivo.split("/")[-2], r.filas) for r in counts) == [("a", 2), ("b", 1)]


def test_a_broken_file_is_no_missing_file(spark, tmp_path):
    write(tmp_path / "x.parquet", "no parquet")
    write(tmp_path / "x.csv", "a\n1\n")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        folders.read_dynamic(spark, str(tmp_path / "x")).collect()
    write(tmp_path / "y.csv", "a\n1\n")
    assert rows(folders.read_dynamic(spark, str(tmp_path / "y"))) == [("1",)]


def test_small_costs_add_up(spark):
    df = spark.createDataFrame([("2024-01-01 08:00:00", "g", "1", "0.0049")] * 2, "t string, g string, v string, c string")
    assert [(r.valor_movimiento, r.costo) for r in daily_volume(df, VolumeSpec("s", "t", "g", "v", cost="c")).collect()] == [(2.0, 0.0098)]


def test_a_payment_loads_once(spark):
    paid = [("1", date(2024, 1, 2), decimal.Decimal("10.50"), "f.csv")] * 2 + [("1", date(2024, 1, 2), decimal.Decimal("10.50"), "g.csv")]
    df = spark.createDataFrame(paid, "obligacion string, fecha date, valor_decimal decimal(18,2), origen string")
    assert len(payments.payment_load(df, date(2024, 1, 15)).collect()) == 2


def test_only_our_campaign_of_the_house_layout(spark, tmp_path):
    write(tmp_path / "a.csv", "Cuenta;Pago;Fecha\n1;5;2024-01-01\nbad line;x\n")
    write(tmp_path / "b.csv", "CUENTA,Fecha de Creación,Nombre Casa de Cobro,Codigo de Campaña\n2,6,2024-01-02,UNIF - RECUPERA SAS\n3,7,2024-01-03,OTRA\n")
    got = rows(payments.read_payments(spark, str(tmp_path)).select("obligacion", "valor", "fecha", "archivo"))
    assert got == [("1", "5", "2024-01-01", "a.csv"), ("2", "6", "2024-01-02", "b.csv")]


def test_rank_of_a_key_with_half_of_the_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k string, v long"))
    got = ranked(df.repartition(7), ["k"], ["v"])
    hot = sorted((r.orden, r.v) for r in got.where("k = 'hot'").collect())
    assert hot == [(i + 1, 2 * i) for i in range(2000)]
    assert {r.orden for r in got.where("k is not null and k <> 'hot'").collect()} == {1}
    assert sorted((r.orden, r.v) for r in got.where("k is null").collect()) == [(1, 1), (2, 2)]


def test_items_keep_order_across_parts(spark):
    df = spark.createDataFrame([("a", f"{i:03d}") for i in range(7)] * 2 + [("b", "x"), ("b", None)], "k string, v string")
    got = rows(items_per_key(df, "k", "v", "items", limit=3))
    assert got == [("a", 0, "000;001;002"), ("a", 1, "003;004;005"), ("a", 2, "006"), ("b", 0, "x")]


def test_region_of_the_first_rule(spark):
    rules = spark.createDataFrame([(2, "BOGO", "B"), (1, "GOTA", "A"), (3, "X", "C")] + [(10 + i, f"T{i}", "D") for i in range(50)], "prioridad int, pueblo string, departamento string")
    df = spark.createDataFrame([("bogota/centro",), ("ax",), ("t49",), ("nada",), ("A",)], "lugar string")
    got = rows(map_region(df, "lugar", rules, ["A", "B", "C", "D"]))
    assert got == [("A", "A"), ("ax", "C"), ("bogota/centro", "A"), ("nada", "NO IDENTIFICADO"), ("t49", "D")]


def test_long_numbers_are_numbers(evaluate):
    assert evaluate(whole("c0"), [("12345678901234567890.7",), ("7",), ("x",)]) == [decimal.Decimal("12345678901234567890"), 7, None]


def test_unapplied_payments_of_few_rows(spark):
    df = spark.createDataFrame([("1000000001", "5.0", "f", "2024-01-01")], "CUSTCODE string, MONTO string, archivo string, fecha_archivo string")
    assert len(payments.unapplied_payments(df)[0].collect()) == 1
    assert payments.unapplied_payments(df, least=5)[0].collect() == []
