"""Scans and sinks on files written by the tests themselves."""

import pytest

from dunlake.functions import fixed_values as fixed
from dunlake.operators.projection import normalised_name, unique_names
from dunlake.session import new_path
from dunlake.sources import folders, layouts, sinks, text


def write(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode(encoding))
    return str(path)


@pytest.mark.parametrize("line,order,expected", [
    ("a;b,c", "union", ","), ("a;b\tc", "union", ";"), ("a\tb|c", "payments", "\t"), ("a|b;c", "payments", "|"),
    ("a b", "payments", " "), ("a;b;c,d", "count", ";"), ("a,b", "count", ","),
])
def test_separator(spark, tmp_path, line, order, expected):
    assert text.sniff_separator(spark, write(tmp_path, "x.csv", line + "\n1\n"), order) == expected


def test_encodings(spark, tmp_path):
    assert text.detect_encoding(spark, write(tmp_path, "u.csv", "a\nñ\n")) == "UTF-8"
    path = write(tmp_path, "w.csv", "a;b\nñ;€\n", "windows-1252")
    assert text.detect_encoding(spark, path) == "windows-1252"
    assert [tuple(r) for r in text.read_text_table(spark, path, encoding="windows-1252").collect()] == [("ñ", "€")]
    assert text.detect_encoding(spark, write(tmp_path, "l.csv", "a\nñ\x81\n", "latin-1")) == "ISO-8859-1"


def test_ragged_lines(spark, tmp_path):
    path = write(tmp_path, "r.csv", "a;b\n1;2\n3\n4;5;6\n")
    assert text.read_text_table(spark, path).count() == 3
    kept = text.read_text_table(spark, path, malformed="DROPMALFORMED")
    assert [tuple(r) for r in kept.collect()] == [("1", "2")]
    assert kept.select("a").count() == 1


def test_positional_and_preamble(spark, tmp_path):
    path = write(tmp_path, "p.csv", "k;c;c;x\n1;2;3;4\n5;6\n")
    df = text.read_positional(spark, path, drop=[3])
    assert df.columns == ["k", "c", "c_1"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("5", "6", None)]
    path = write(tmp_path, "s.csv", "t1\nt2\n\na,b\n1,\"x,y\"\n2,z\n")
    assert sorted(tuple(r) for r in text.read_after_preamble(spark, path).collect()) == [("1", "x,y"), ("2", "z")]


def test_folder_of_different_layouts(spark, tmp_path):
    write(tmp_path, "in/a.csv", "﻿k;v\n1;x\n")
    write(tmp_path, "in/b.csv", "v;w\ny;2\n")
    df = folders.read_folder_any(spark, str(tmp_path / "in"))
    assert sorted(map(str, ((r["k"], r["v"], r["w"]) for r in df.collect()))) == sorted(
        map(str, [("1", "x", None), (None, "y", "2")])
    )
    titles = {r["archivo"]: r["titulos"] for r in folders.schema_inventory(spark, str(tmp_path / "in")).collect()}
    assert titles == {"a.csv": "k,v", "b.csv": "v,w"}
    write(tmp_path, "other/c.txt", "x\n")
    with pytest.raises(FileNotFoundError):
        folders.read_folder_any(spark, str(tmp_path / "other"))


def test_dynamic_prefers_parquet(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        folders.read_dynamic(spark, base)
    write(tmp_path, "t.csv", "a\n1\n")
    assert folders.read_dynamic(spark, base).first()[0] == "1"
    spark.range(1).write.parquet(base + ".parquet")
    assert folders.read_dynamic(spark, base).columns == ["id"]


def test_layouts():
    for name, columns in fixed.VENDOR_LAYOUTS:
        assert layouts.classify_layout([c.upper() for c in columns] + ["extra"]) == name
    assert layouts.classify_layout(["a"]) == fixed.UNKNOWN_LAYOUT


def test_headers():
    assert unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]
    assert normalised_name(" Casa Cobro. ", "word") == "casacobro"
    assert normalised_name("Número {x}.", "ascii") == "Numero x"


def test_write_by_key_needs_its_key(spark):
    with pytest.raises(ValueError):
        sinks.write_by_key(spark.range(1), "marca", new_path(spark, "never"))
