"""Delimited text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlake.functions import fixed_values as fixed
from dunlake.operators.projection import unique_names
from dunlake.sources.states import UNUSED_CONTROLS, detect_encoding  # noqa: F401

ASSIGNMENT_COLUMNS = tuple(f"{i}_" for i in range(1, 63))
# Windows-1252 is latin-1 with printable signs in place of these control characters;
# Spark reads latin-1, the signs are put in afterwards.
_LATIN_CONTROLS = "".join(c for c in map(chr, range(0x80, 0xA0)) if c not in UNUSED_CONTROLS)
_WINDOWS_SIGNS = _LATIN_CONTROLS.encode("latin-1").decode("windows-1252")
SEPARATOR_ORDERS = {
    "union": (",", ";", "\t"),
    "payments": ("\t", "|", ";", ",", " "),
}


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_text_table(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ";",
    encoding: str = "UTF-8",
    malformed: str = "PERMISSIVE",
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Delimited scan with a header row; every column is text.

    ``malformed="DROPMALFORMED"`` drops ragged lines, the default pads or cuts them.
    Give ``schema`` (all columns present, in file order) to skip reading the header.
    A UTF-16 file is one task's work, as its lines can't be told apart by single bytes.
    """
    windows = encoding.lower() in ("windows-1252", "cp1252")
    if encoding.upper().startswith("UTF-16"):
        options = {"multiLine": "true", **options}
    reader = spark.read.options(
        header=True, sep=sep, encoding="ISO-8859-1" if windows else encoding, mode=malformed, **options
    )
    if malformed == "DROPMALFORMED":
        # a pruned parser would not see that a line has too few or too many fields
        reader = reader.option("columnPruning", False)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path if isinstance(path, str) else list(path))
    if not windows:
        return df
    return df.select(*[F.translate(F.col(f"`{c}`"), _LATIN_CONTROLS, _WINDOWS_SIGNS).alias(c) for c in df.columns])


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).head()
    return "" if row is None else row[0].lstrip("﻿")


def sniff_separator(spark: SparkSession, path: str, order: str | Sequence[str] = "payments") -> str:
    """Separator of the first line: the first of a priority list that occurs in it.

    ``order="count"`` compares the number of ';' and ','. Only one line is read.
    """
    line = first_line(spark, path)
    if order == "count":
        return ";" if line.count(";") >= line.count(",") else ","
    candidates = SEPARATOR_ORDERS[order] if isinstance(order, str) else tuple(order)
    for sep in candidates[:-1]:
        if sep in line:
            return sep
    return candidates[-1]


def read_positional(spark: SparkSession, path: str, drop: Sequence[int] = (), sep: str = ";") -> DataFrame:
    """Scan by position: repeated header names get a suffix, columns in ``drop`` are left out.

    Lines shorter or longer than the header are padded with null or cut.
    """
    names = unique_names(first_line(spark, path).split(sep))
    df = read_text_table(spark, path, sep, schema=text_schema(names), enforceSchema="true")
    return df.select(*[F.col(f"`{name}`") for i, name in enumerate(names) if i not in set(drop)])


def read_after_preamble(spark: SparkSession, path: str, lines: int = 3, sep: str = ",") -> DataFrame:
    """Scan a file whose header follows ``lines`` lines of preamble.

    The first lines are dropped by their place in the file, so a later line equal to one of them stays.
    """
    head = [row[0] for row in spark.read.text(path).head(lines + 1)]
    schema = text_schema(unique_names(head[-1].split(sep)))
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line")
    )
    # Lines of a block are numbered in order, from some number of the task on.
    first = rows.agg(F.min(F.when(F.col("_start") == 0, F.col("_line")))).scalar()
    body = rows.filter((F.col("_start") > 0) | (F.col("_line") > first + lines))
    return body.select(F.from_csv("value", _ddl(schema), {"sep": sep}).alias("row")).select("row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{field.name}` STRING" for field in schema.fields)


def read_assignment(spark: SparkSession, path: str, origins: Sequence[str] = fixed.ORIGINS) -> DataFrame:
    """62-column assignment file in latin-1, all text, rows of the known origins only."""
    df = read_text_table(
        spark, path, encoding="ISO-8859-1", schema=text_schema(ASSIGNMENT_COLUMNS), enforceSchema="true"
    )
    return df.filter(F.col("3_").isin(*origins))
