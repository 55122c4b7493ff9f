"""Folder scans."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlake.operators.projection import quoted, unique_names
from dunlake.operators.unions import union_all
from dunlake.sources.states import READABLE, file_encodings, file_states, literal, piece, source_path
from dunlake.sources.text import SEPARATOR_ORDERS, read_text_table, text_schema


def read_dynamic(spark: SparkSession, base: str, sep: str = ";") -> DataFrame:
    """``base.parquet`` if it is there, else ``base.csv``; an error when neither is.

    Only a missing path leads on; a file that is there but can't be read is an error.
    """
    for read in (lambda: spark.read.parquet(f"{base}.parquet"), lambda: read_text_table(spark, f"{base}.csv", sep)):
        try:
            return read()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no file for {base}")


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c).cast("string").alias(c) for c in df.columns])


def file_headers(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """(archivo, encabezado): plain path and first line of each readable text file, from its beginning only."""
    states = file_states(spark, folder, pattern, recursive).where(F.col("estado") == READABLE)
    return states.select(F.col("ruta").alias("archivo"), "encabezado")


def schema_inventory(
    spark: SparkSession, folder: str, pattern: str = "*.csv", sep: str = ";", recursive: bool = False
) -> DataFrame:
    """One row per text or Parquet file with its titles joined by commas; no row is read."""
    states = file_states(spark, folder, pattern, recursive).where(F.col("estado") == READABLE)
    return states.select("archivo", F.replace(F.col("encabezado"), F.lit(sep), F.lit(",")).alias("titulos"))


def header_separator(header: str, order: str | Sequence[str] = "union") -> str:
    """First separator of a priority list that occurs in a header line; the last of the payment list, else the first."""
    candidates = SEPARATOR_ORDERS[order] if isinstance(order, str) else tuple(order)
    found = next((s for s in candidates if s in header), None)
    return found or (candidates[-1] if order == "payments" else candidates[0])


def _header_schema(header: str, sep: str) -> T.StructType:
    return text_schema(unique_names(next(csv.reader([header], delimiter=sep))))


def read_text_files(
    spark: SparkSession,
    folder: str,
    pattern: str,
    sep: str | None = None,
    recursive: bool = False,
    origin: str | None = None,
    parent: str | None = None,
    each: Callable[[DataFrame], DataFrame] | None = None,
    order: str | Sequence[str] = "union",
    encoding: str | None = None,
    states: DataFrame | None = None,
    **options: str,
) -> DataFrame | None:
    """All readable text files of a folder, united by column name; files without a line are left out.

    Files are grouped by their header line and encoding, which are read off their beginnings, so every row is read once
    and the number of scans follows the layouts, not the files; a folder of one layout is scanned as a whole. The driver
    sees one short row per file, as its own file listing does. Without ``sep`` each layout's separator is the first of
    ``order`` in its header. ``encoding="auto"`` finds each file's encoding in a pass over its bytes; None reads UTF-8,
    but files with a mark of UTF-16 as such. ``origin`` adds the file name in a column of that name, ``parent`` that of
    its folder, both as they are in the file system; ``each`` is applied to the table of each layout. ``states`` is the
    table of the files if it is known. Null when no file can be read.
    """
    if states is None:
        of = file_encodings if encoding == "auto" else file_states
        states = of(spark, folder, pattern, recursive)
    files: dict[tuple[str, str], list[str]] = {}
    whole = True
    for row in states.select("ruta", "encabezado", "codificacion", "estado").toLocalIterator():
        if row["estado"] != READABLE:
            whole = False
            continue
        told = row["codificacion"]
        read_as = told if encoding == "auto" or told == "UTF-16" else encoding or "UTF-8"
        files.setdefault((row["encabezado"], read_as), []).append(row["ruta"])
    parts = []
    for (header, read_as), paths in sorted(files.items()):
        separator = sep or header_separator(header, order)
        given = {"encoding": read_as, **options}
        if read_as == "UTF-16":  # its schema is not looked up by Spark, which would read the files as a whole
            given["schema"] = _header_schema(header, separator)
        if len(files) == 1 and whole:
            given |= {"pathGlobFilter": pattern, "recursiveFileLookup": str(recursive).lower()}
            table = read_text_table(spark, folder, separator, **given)
        else:
            table = read_text_table(spark, [literal(path) for path in paths], separator, **given)
        if origin is not None or parent is not None:
            path = source_path()
            places = {origin: piece(path, -1), parent: piece(path, -2)}
            table = table.select("*", *[place.alias(name) for name, place in places.items() if name is not None])
        table = as_text(table)
        parts.append(table if each is None else each(table))
    return union_all(parts) if parts else None


def read_parquet_files(spark: SparkSession, folder: str, states: DataFrame) -> DataFrame | None:
    """Readable Parquet files of a folder as text, united by name; files of one schema are one scan, so types may differ."""
    files: dict[str | None, list[str]] = {}
    for row in states.where(F.col("estado") == READABLE).select("ruta", "columnas").toLocalIterator():
        files.setdefault(row["columnas"], []).append(row["ruta"])
    merged = {"mergeSchema": "true"} if None in files else {}
    parts = [as_text(spark.read.options(**merged).parquet(*[literal(p) for p in paths])) for _, paths in sorted(files.items(), key=str)]
    return union_all(parts) if parts else None


def read_folder_any(spark: SparkSession, folder: str, sep: str = ";", encoding: str | None = None) -> DataFrame:
    """CSV and Parquet files of a folder as text, united by name; ``skipped_files`` tells which are left out.

    Each file is in or out as a whole, judged by its beginning or its footer: text files without a line or with binary
    content, files that can't be opened and Parquet files with a broken footer are skipped.
    """
    of = file_encodings if encoding == "auto" else file_states
    texts, parquets = of(spark, folder, "*.csv"), file_states(spark, folder, "*.parquet")
    found = [read_text_files(spark, folder, "*.csv", sep, encoding=encoding, states=texts), read_parquet_files(spark, folder, parquets)]
    parts = [part for part in found if part is not None]
    if not parts:
        raise FileNotFoundError(f"no readable CSV or Parquet file in {folder}")
    return union_all(parts)


def skipped_files(spark: SparkSession, folder: str) -> DataFrame:
    """(archivo, estado) of the CSV and Parquet files that ``read_folder_any`` leaves out."""
    states = file_states(spark, folder, "*.csv").unionByName(file_states(spark, folder, "*.parquet"))
    return states.where(F.col("estado") != READABLE).select("archivo", "estado")


def read_tree(
    spark: SparkSession, folder: str, separators: Mapping[str, str] | None = None, encoding: str | None = None
) -> DataFrame:
    """All files below a folder, by extension and separator, united by name."""
    separators = separators or {"csv": ";", "txt": "\t"}
    parts = [
        part
        for extension, sep in separators.items()
        if (part := read_text_files(spark, folder, f"*.{extension}", sep, recursive=True, encoding=encoding)) is not None
    ]
    if not parts:
        raise FileNotFoundError(f"no file with extension {list(separators)} below {folder}")
    return union_all(parts)


def merge_files(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct rows of all CSV files, each layout with its own separator."""
    rows = read_text_files(spark, folder, "*.csv")
    if rows is None:
        raise FileNotFoundError(f"no readable CSV file in {folder}")
    return rows.distinct()


def with_file_meta(df: DataFrame, name: str = "archivo", day: str = "fecha_archivo") -> DataFrame:
    """File name and modification day of each row; call it right on a scan."""
    return df.select(
        "*",
        piece(source_path(), -1).alias(name),
        F.col("_metadata.file_modification_time").cast("date").alias(day),
    )


def with_parent_folder(df: DataFrame, name: str = "carpeta") -> DataFrame:
    """Name of the folder that holds the file of each row; call it right on a scan."""
    return df.select("*", piece(source_path(), -2).alias(name))


def merge_by_folder(
    spark: SparkSession, folder: str, sep: str = ";", pattern: str = "*.csv", columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of all files below a folder, united by column name, with their parent folder, ready to be written by it."""
    rows = read_text_files(spark, folder, pattern, sep, recursive=True, parent="carpeta")
    if rows is None:
        raise FileNotFoundError(f"no file {pattern} below {folder}")
    return rows if columns is None else rows.select(*columns, "carpeta")


def file_row_counts(spark: SparkSession, folder: str, pattern: str = "*.csv", sep: str = ";") -> DataFrame:
    """Rows per file below a folder, header not counted; files of one name in different folders count apart."""
    rows = spark.read.options(
        header=True, sep=sep, recursiveFileLookup="true", pathGlobFilter=pattern
    ).csv(folder)
    return rows.groupBy(source_path().alias("archivo")).agg(F.count("*").alias("filas"))
