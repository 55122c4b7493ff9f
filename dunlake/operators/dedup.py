"""Dedup, ordering, row numbers and consecutive splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunlake.functions.base import ColumnLike, as_column
from dunlake.session import new_path, store


def _ascending(order: Sequence[ColumnLike]) -> list[Column]:
    return [as_column(item) for item in order]


def top_rows(df: DataFrame, keys: Sequence[ColumnLike], order: Sequence[ColumnLike], n: int, rank: str) -> DataFrame:
    """First ``n`` rows of each key, numbered in ``rank``.

    Spark keeps at most ``n`` rows per key on the map side before the shuffle,
    so a key holding a large share of the rows does not fill one task.
    """
    window = Window.partitionBy(*_ascending(keys)).orderBy(*_ascending(order))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total for a fixed survivor."""
    return top_rows(df, keys, order, 1, "_rank").drop("_rank")


def ordered(df: DataFrame, columns: Sequence[ColumnLike], ascending: bool | list[bool] = True) -> DataFrame:
    """One global sort. End the list with a unique column: ranges cannot split equal keys."""
    return df.orderBy(*_ascending(columns), ascending=ascending)


def numbered(df: DataFrame, order: Sequence[ColumnLike], name: str = "fila", file: str | None = None) -> DataFrame:
    """Global zero-based row number without a single-task window; ``file`` names a column for the number of the file.

    The range-sorted rows are written to the shared work folder. A row's number
    is the rows in earlier files plus its place in its own file; the window
    below runs over one row per file only.
    """
    spark = df.sparkSession
    path = new_path(spark, "numbered")
    df.repartitionByRange(*_ascending(order)).sortWithinPartitions(*_ascending(order)).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place")
    )
    # The number in a file's name is that of its range; as text it would not sort beyond five digits.
    number = F.regexp_extract("_file", "^part-([0-9]+)", 1).cast("bigint")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        spark.read.schema(df.schema).parquet(path)
        .groupBy(F.col("_metadata.file_name").alias("_file"))
        .agg(F.count("*").alias("_rows"))
        .withColumn("_part", number)
        .select("_file", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    # One row per written file, at most one file per shuffle partition: safe to broadcast.
    return rows.join(F.broadcast(files), "_file").select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_before") + F.col("_place")).alias(name),
        *([F.col("_part").alias(file)] if file else []),
    )


def split_rows(df: DataFrame, n: int, order: Sequence[ColumnLike], column: str = "parte") -> DataFrame:
    """N consecutive row ranges of equal size; the last one takes the remainder.

    With fewer rows than ranges all rows are in the last part.
    """
    rows = numbered(df, order, "_number")
    total = rows.agg(F.count("*")).scalar()
    size = F.floor(total / F.lit(n)).cast("bigint")
    part = F.when(total < n, F.lit(n - 1)).otherwise(
        F.least(F.lit(n - 1), F.floor(F.col("_number") / F.greatest(size, F.lit(1))))
    )
    return rows.withColumn(column, part.cast("int")).drop("_number")


#: A key of more rows is ranked over many tasks; the rows of any other key are sorted by one.
HEAVY_ROWS = 1_000_000


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[ColumnLike],
    rank: str = "orden",
    n: int | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Rank inside a key. With ``n`` only the first ``n`` rows are kept and ranked.

    Without a bound a key may hold any number of rows. The rows of each key are counted first, combined on the map side.
    If no key has more than ``heavy_rows``, the result is one window behind one shuffle. Else the heavy keys are stored,
    and only their rows are ranked over many tasks.
    """
    if n is not None:
        return top_rows(df, keys, order, n, rank)
    key_columns = [F.col(f"`{k}`") for k in keys]
    heavy = df.groupBy(*key_columns).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > heavy_rows).select(*key_columns)
    heavy = store(heavy, "heavy-keys")
    window = F.row_number().over(Window.partitionBy(*key_columns).orderBy(*_ascending(order))).cast("bigint")
    if heavy.isEmpty():
        return df.withColumn(rank, window)
    light = join_null_safe(df, heavy, keys, "left_anti").withColumn(rank, window)
    return light.unionByName(ranked_by_number(join_null_safe(df, heavy, keys, "left_semi"), keys, order, rank))


def ranked_by_number(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], rank: str) -> DataFrame:
    """Rank inside keys that each may outgrow a task: the global row number minus the first number of the key.

    The rows of a key are sorted into one or more files; first numbers are joined by key and file, so a key that spans
    many files is spread over as many groups.
    """
    rows = numbered(df, [*[F.col(f"`{k}`") for k in keys], *order], "_number", "_part")
    by_file = rows.groupBy(*[F.col(f"`{k}`") for k in keys], "_part").agg(F.min("_number").alias("_first"))
    first = by_file.withColumn("_first", F.min("_first").over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys])))
    return join_null_safe(rows, first, [*keys, "_part"], "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_number") - F.col("_first") + 1).alias(rank),
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on same-named keys where null equals null; the left keys are kept."""
    named = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[f"`{key}`"].eqNullSafe(named[f"`_right_{key}`"])
    return left.join(named, condition, how).drop(*[f"_right_{key}" for key in keys])
