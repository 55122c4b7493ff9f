"""What is known of each file of a folder before its rows are read: place, size, header, encoding, readable or not.

A table with one row a file. The listing is Spark's own; the beginning of each text file, or the footer of each Parquet
file, is read by the task that holds the file's row, so no file is scanned for it. Files are in or out as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 16
READABLE, EMPTY, BINARY, BROKEN = "legible", "vacio", "binario", "ilegible"
#: Encodings are tried in this order; latin-1 fits any bytes.
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
#: Control characters of latin-1 that Windows-1252 has no sign for.
UNUSED_CONTROLS = "\x81\x8d\x8f\x90\x9d"


def plain_path(uri: Column) -> Column:
    """Path as people write it; Spark's file metadata has it percent-encoded, with plus signs as they are."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def source_path() -> Column:
    """Plain path of each row's file; use it right on a scan."""
    return plain_path(F.col("_metadata.file_path"))


def piece(path: Column, place: int) -> Column:
    """Part of a path, counted from its end: -1 is the name, -2 its folder."""
    return F.element_at(F.split(path, "/"), place)


def literal(path: str) -> str:
    """Path for a reader that would take these signs for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def listing(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """(ruta, bytes, modificado) of the files of a folder; nothing of their content is read."""
    found = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=str(recursive).lower())
    return found.load(folder).select(F.col("path").alias("ruta"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modificado"))


def opens_in_tasks(files: DataFrame) -> bool:
    """Whether Python can open the listed files by itself, as the first of them tells; other stores are left to Spark's readers."""
    from pyarrow import fs

    first = files.select("ruta").head()
    if first is None or first[0].startswith("file:"):
        return True
    authority, inner = re.fullmatch(r"(\w+://[^/]*)?(.*)", first[0], re.DOTALL).groups()
    try:
        system, root = fs.FileSystem.from_uri(f"{authority}/" if authority else "file:///")
        return system.get_file_info(root.rstrip("/") + inner).type != fs.FileType.NotFound
    except (OSError, pa.ArrowException):
        return False


_DDL = "ruta string, bytes long, modificado timestamp, encabezado string, codificacion string, columnas string, estado string"


def _head_reader(head_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The tasks' function with all that it needs, so that workers need no copy of this package."""
    readable, empty, binary, broken, unused = READABLE, EMPTY, BINARY, BROKEN, UNUSED_CONTROLS

    def run(batches):
        import codecs
        import json

        import pyarrow as arrow
        from pyarrow import fs, parquet

        def place(path):
            if path.startswith("file:"):
                return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            if "://" not in path:
                return fs.LocalFileSystem(), path
            scheme, rest = path.split("://", 1)
            authority, _, inner = rest.partition("/")
            system, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
            return system, root.rstrip("/") + "/" + inner

        def encoding_of(raw):
            for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16"), (codecs.BOM_UTF16_BE, "UTF-16")):
                if raw.startswith(mark):
                    return name
            if b"\0" in raw:
                return None
            try:
                codecs.getincrementaldecoder("utf-8")().decode(raw)
                return "UTF-8"
            except UnicodeDecodeError:
                return "ISO-8859-1" if any(ord(c) in raw for c in unused) else "windows-1252"

        def text_state(raw):
            encoding = encoding_of(raw)
            if not raw:
                return None, None, None, empty
            if encoding is None:
                return None, None, None, binary
            lines = codecs.getincrementaldecoder("latin-1" if encoding == "ISO-8859-1" else encoding)("replace").decode(raw)
            header = next((line for line in lines.lstrip("﻿").splitlines() if line.strip()), None)
            return header, encoding, None, empty if header is None else readable

        def state(path):
            try:
                system, inner = place(path)
                if path.endswith(".parquet"):
                    with system.open_input_file(inner) as file:
                        schema = parquet.read_metadata(file).schema.to_arrow_schema()
                    return ",".join(schema.names), None, json.dumps([[f.name, str(f.type)] for f in schema]), readable
                with system.open_input_stream(inner, compression=None) as file:
                    return text_state(file.read(head_bytes))
            except (PermissionError, FileNotFoundError, arrow.ArrowException):
                return None, None, None, broken
            except OSError as error:  # a store that fails for now has a code: the task is tried again, the file not skipped
                if error.errno is not None:
                    raise
                return None, None, None, broken

        for batch in batches:
            found = [state(path) for path in batch.column("ruta").to_pylist()]
            columns = [arrow.array([f[k] for f in found], arrow.string()) for k in range(4)]
            yield arrow.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "encabezado", "codificacion", "columnas", "estado"])

    return run


def file_states(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """One row a file: ruta, archivo, carpeta, bytes, modificado, encabezado, codificacion, columnas, estado.

    ``encabezado`` is the first line that is not blank (of Parquet files the column names, joined by commas),
    ``codificacion`` what the first HEAD_BYTES bytes are in, ``columnas`` the types of a Parquet file. ``estado`` is
    "vacio" without any line (a file of no byte has no row here), "binario" with zero bytes that no mark of UTF-16 explains, "ilegible" when the file can't
    be opened or a Parquet footer is broken, and else "legible".

    Where only Spark's readers reach the files, headers of text files come from a scan, and all files count as readable.
    """
    files = listing(spark, folder, pattern, recursive)
    if opens_in_tasks(files):
        states = files.mapInArrow(_head_reader(HEAD_BYTES), _DDL)
    else:
        states = _scanned_states(spark, folder, pattern, recursive, files)
    return states.select("ruta", piece(F.col("ruta"), -1).alias("archivo"), piece(F.col("ruta"), -2).alias("carpeta"), *[c.split()[0] for c in _DDL.split(", ")[1:]])


def _scanned_states(spark: SparkSession, folder: str, pattern: str, recursive: bool, files: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    if pattern.endswith(".parquet"):
        return files.select("*", none.alias("encabezado"), none.alias("codificacion"), none.alias("columnas"), F.lit(READABLE).alias("estado"))
    lines = spark.read.options(pathGlobFilter=pattern, recursiveFileLookup=str(recursive).lower()).text(folder)
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    first = lines.where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != "")).groupBy(source_path().alias("_ruta")).agg(F.min_by("value", at).alias("encabezado"))
    joined = files.join(first, F.col("ruta") == F.col("_ruta"), "left")
    state = F.when(F.col("encabezado").isNull(), EMPTY).otherwise(READABLE)
    return joined.select(*files.columns, F.ltrim("encabezado", F.lit("﻿")).alias("encabezado"), F.lit("UTF-8").alias("codificacion"), none.alias("columnas"), state.alias("estado"))


def byte_classes(lines: DataFrame) -> tuple[Column, Column]:
    """Aggregates over raw lines: whether any is no UTF-8, and whether any has a control that Windows-1252 lacks."""
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    wrong = ~F.is_valid_utf8("value")
    return F.coalesce(F.bool_or(wrong), F.lit(False)), F.coalesce(F.bool_or(wrong & latin.rlike(f"[{UNUSED_CONTROLS}]")), F.lit(False))


def first_fit(wrong: Column, controls: Column, encodings: Sequence[str] = ENCODINGS) -> Column:
    """First encoding of the list that fits the bytes; when none does the first one, whose reader puts U+FFFD for bad bytes."""
    fits = {"utf-8": ~wrong, "windows-1252": ~wrong | ~controls, "cp1252": ~wrong | ~controls}
    chosen = F.lit(encodings[0])
    for name in reversed(encodings):
        chosen = F.when(fits.get(name.lower(), F.lit(True)), F.lit(name)).otherwise(chosen)
    return chosen


def file_encodings(
    spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False, encodings: Sequence[str] = ENCODINGS
) -> DataFrame:
    """The table of states, with the encoding of each file as its whole content tells: one pass, two flags a file.

    A mark at the beginning decides at once: UTF-16 and UTF-8 files with one need not be valid otherwise.
    """
    states = file_states(spark, folder, pattern, recursive)
    lines = spark.read.options(pathGlobFilter=pattern, recursiveFileLookup=str(recursive).lower()).text(folder)
    wrong, controls = byte_classes(lines)
    flags = lines.groupBy(source_path().alias("_ruta")).agg(wrong.alias("_wrong"), controls.alias("_controls"))
    joined = states.join(flags, F.col("ruta") == F.col("_ruta"), "left")
    told = F.when(F.col("codificacion") == "UTF-16", F.lit("UTF-16")).otherwise(
        first_fit(F.coalesce("_wrong", F.lit(False)), F.coalesce("_controls", F.lit(False)), encodings)
    )
    return joined.select(*[told.alias(c) if c == "codificacion" else F.col(c) for c in states.columns])


def detect_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """Encoding that fits all files of a path: their common one, else the last of the list that any of them needs."""
    needed = {r[0] for r in file_encodings(spark, path, "*", encodings=encodings).select("codificacion").distinct().collect()}
    return next((name for name in ("UTF-16", *reversed(encodings)) if name in needed), encodings[0])
