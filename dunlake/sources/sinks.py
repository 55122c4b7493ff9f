"""Sinks and conversions (K1-K5, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dunlake.functions import fixed_values as fixed
from dunlake.operators.projection import quoted
from dunlake.sources.folders import read_text_files


def with_files(df: DataFrame, n: int | None) -> DataFrame:
    """Spread the output over ``n`` files; None keeps the partitions the plan has."""
    return df if n is None else df.repartition(n)


def write_csv(
    df: DataFrame, path: str, n: int | None = None, sep: str = ";", max_rows: int | None = None, mode: str = "errorifexists"
) -> None:
    writer = with_files(df, n).write.mode(mode).options(header=True, sep=sep)
    if max_rows is not None:
        writer = writer.option("maxRecordsPerFile", max_rows)
    writer.csv(path)


def write_payment_files(df: DataFrame, path: str, max_rows: int = fixed.ROWS_PER_PAYMENT_FILE) -> None:
    """CSV files of at most ``max_rows`` rows each."""
    write_csv(df, path, max_rows=max_rows)


def write_parquet(df: DataFrame, path: str, n: int | None = None, compression: str = "snappy") -> None:
    with_files(df, n).write.option("compression", compression).parquet(path)


def write_json(df: DataFrame, path: str, n: int | None = None) -> None:
    with_files(df, n).write.json(path)


def convert(spark: SparkSession, source: str, target: str, fmt: str, sep: str | None = None, encoding: str = "UTF-8") -> None:
    """Convert the CSV files of a folder to Parquet or JSON lines."""
    rows = read_text_files(spark, source, "*.csv", sep, encoding=encoding)
    if rows is None:
        raise FileNotFoundError(f"no CSV file in {source}")
    if fmt == "parquet":
        write_parquet(rows, target, compression="zstd")
    elif fmt == "json":
        write_json(rows, target)
    else:
        raise ValueError(f"unknown target format {fmt!r}")


def write_by_key(df: DataFrame, key: str, path: str, columns=None, fmt: str = "csv") -> None:
    """One output folder per value of a key, after a fixed projection.

    The rebalance hint gathers the rows of a value into few files and still
    splits a value that holds many rows, which a plain repartition would not.
    """
    if key not in df.columns:
        raise ValueError(f"key column {key} is missing")
    rows = df if columns is None else df.select(*[quoted(c) for c in columns])
    writer = rows.hint("rebalance", quoted(key)).write.partitionBy(key)
    if fmt == "csv":
        writer.options(header=True, sep=";").csv(path)
    else:
        writer.format(fmt).save(path)
