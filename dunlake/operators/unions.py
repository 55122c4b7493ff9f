"""Unions (U2, U4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions.base import ColumnLike
from dunlake.functions.contacts import contact_type
from dunlake.operators.dedup import dedup


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a part lacks are null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def upsert_contacts(lake: DataFrame, new: DataFrame, order: Sequence[ColumnLike] = ("document",)) -> DataFrame:
    """Contact lake and new rows, unique by account and contact, with the contact type."""
    columns = ["document", "account", "demographic"]
    rows = lake.select(*columns).unionByName(new.select(*columns))
    return dedup(rows, ["account", "demographic"], order).withColumn(
        "type", contact_type(F.col("demographic"), cleaned=False)
    )
