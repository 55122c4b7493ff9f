"""Folders with hard names, broken files, and files of different encodings and separators."""

from dunlake.plans import payments
from dunlake.sources import folders, sinks, text
from dunlake.sources.states import file_encodings, file_states


def put(path, content, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_names_with_blanks_and_accents(spark, tmp_path):
    base = tmp_path / "año uno+dos"
    put(base / "sub a%20b/Pagos año 1.csv", "k;v\n1;x\n")
    put(base / "sub [c]/Pagos {2}.csv", "v;w\ny;2\n")
    united = folders.read_tree(spark, str(base))
    assert rows(united.select("k", "v", "w")) == [("1", "x", None), (None, "y", "2")]
    by_folder = folders.merge_by_folder(spark, str(base))
    assert {r["carpeta"] for r in by_folder.collect()} == {"sub a%20b", "sub [c]"}
    titles = folders.schema_inventory(spark, str(base), recursive=True)
    assert {(r["archivo"], r["titulos"]) for r in titles.collect()} == {("Pagos año 1.csv", "k,v"), ("Pagos {2}.csv", "v,w")}
    counts = {r["archivo"].rsplit("/", 2)[-2:][0] + "/" + r["archivo"].rsplit("/", 1)[-1]: r["filas"] for r in folders.file_row_counts(spark, str(base)).collect()}
    assert counts == {"sub a%20b/Pagos año 1.csv": 1, "sub [c]/Pagos {2}.csv": 1}
    one = text.read_text_table(spark, str(base / "sub a%20b"))
    assert [r["archivo"] for r in folders.with_file_meta(one).collect()] == ["Pagos año 1.csv"]
    sinks.convert(spark, str(base / "sub a%20b"), str(tmp_path / "out"), "parquet")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("1", "x")]


def test_files_that_cannot_be_read_are_skipped_and_named(spark, tmp_path):
    spark.createDataFrame([("1", 2)], "k string, n int").coalesce(1).write.parquet(str(tmp_path / "in"))
    put(tmp_path / "in/good.csv", "k;v\n7;x\n")
    put(tmp_path / "in/empty.csv", "\n\n")
    put(tmp_path / "in/zero.csv", "")  # not listed by Spark, and without any row
    put(tmp_path / "in/binary.csv", b"\x00\x01\x02;\x00")
    put(tmp_path / "in/broken.parquet", b"PAR1 no footer here PAR1")
    put(tmp_path / "in/short.parquet", b"PAR")
    got = folders.read_folder_any(spark, str(tmp_path / "in"))
    assert rows(got.select("k", "n", "v")) == [("1", "2", None), ("7", None, "x")]
    assert rows(folders.skipped_files(spark, str(tmp_path / "in"))) == [
        ("binary.csv", "binario"), ("broken.parquet", "ilegible"), ("empty.csv", "vacio"), ("short.parquet", "ilegible"),
    ]


def test_encoding_of_each_file(spark, tmp_path):
    put(tmp_path / "u.csv", "a;b\n1;ñ€\n")
    put(tmp_path / "w.csv", "a;b\n2;ñ€\n", "windows-1252")
    put(tmp_path / "l.csv", "a;b\n3;ñ\x81\n", "latin-1")
    put(tmp_path / "x.csv", "a;b\n4;ñ€\n", "utf-16")
    found = {r["archivo"]: r["codificacion"] for r in file_encodings(spark, str(tmp_path)).collect()}
    assert found == {"u.csv": "UTF-8", "w.csv": "windows-1252", "l.csv": "ISO-8859-1", "x.csv": "UTF-16"}
    got = folders.read_text_files(spark, str(tmp_path), "*.csv", ";", encoding="auto")
    assert rows(got) == [("1", "ñ€"), ("2", "ñ€"), ("3", "ñ\x81"), ("4", "ñ€")]


def test_a_late_byte_decides_the_encoding(spark, tmp_path):
    put(tmp_path / "w.csv", b"a;b\n" + b"1;x\n" * 30_000 + b"2;\xf1\n")
    assert text_encodings(spark, tmp_path) == ["windows-1252"]


def text_encodings(spark, folder):
    return [r["codificacion"] for r in file_encodings(spark, str(folder)).collect()]


def test_payment_files_of_five_separators(spark, tmp_path):
    names = ("Cuenta", "Pago", "Fecha")
    for i, (name, sep) in enumerate([("a.csv", ";"), ("t.txt", "\t"), ("p.txt", "|"), ("s.txt", " "), ("c.txt", ","), ("k.txt", ";")]):
        put(tmp_path / name, sep.join(names) + "\n" + sep.join((str(i), "5", "2024-01-01")) + "\n")
    put(tmp_path / "u.txt", "Cuenta\tPago\tFecha\tHoy, sí\n9\t5\t2024-01-01\tx\n")
    got = rows(payments.read_payments(spark, str(tmp_path)).select("obligacion", "valor", "fecha", "archivo"))
    assert got == [(str(i), "5", "2024-01-01", n) for i, n in enumerate(["a.csv", "t.txt", "p.txt", "s.txt", "c.txt", "k.txt"])] + [("9", "5", "2024-01-01", "u.txt")]


def test_headers_come_without_a_scan_of_rows(spark, tmp_path):
    put(tmp_path / "a.csv", "k;v\n1;x\n")
    plan = file_states(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "FileScan text" not in plan and "FileScan binaryFile" in plan
