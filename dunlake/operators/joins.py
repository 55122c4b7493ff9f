"""Joins (J1, J3-J7, P5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import ColumnLike
from dunlake.operators.dedup import dedup
from dunlake.session import small_table


def enrich(
    base: DataFrame,
    base_key: str,
    base_order: Sequence[ColumnLike],
    satellites: Sequence[tuple[DataFrame, str, Sequence[ColumnLike]]],
) -> DataFrame:
    """Left-join deduplicated satellites onto a deduplicated base; rows never multiply.

    List the satellites on ``base_key`` first: their dedup and join then share the
    partitioning of the base, which is shuffled once.
    """
    result = dedup(base, [base_key], base_order)
    for table, key, order in satellites:
        result = result.join(dedup(table, [key], order), key, "left")
    return result


def merge_contacts(phones: DataFrame, emails: DataFrame, key: str, identity: str) -> DataFrame:
    """Full outer join by account, with the id taken from either side."""
    other = emails.withColumnRenamed(identity, "_identity")
    return (
        phones.join(other, key, "full")
        .withColumn(identity, F.coalesce(F.col(identity), F.col("_identity")))
        .drop("_identity")
    )


def apply_discount(accounts: DataFrame, discounts: DataFrame, account: str, code: str, percent: str) -> DataFrame:
    """Left join of a discount table whose codes lack the '-' guard; missing is '0'.

    Several discounts of one account give several rows, as the table is not deduplicated.
    """
    right = discounts.select(
        F.concat(F.col(code).cast("string"), F.lit("-")).alias(account),
        F.col(percent).cast("string").alias("_percent"),
    )
    return (
        accounts.join(right, account, "left")
        .withColumn(percent, F.coalesce(F.col("_percent"), F.lit("0")))
        .drop("_percent")
    )


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], want: bool = True) -> DataFrame:
    """Distinct left rows that have, or lack, a partner on the right."""
    return left.join(right.select(*keys), list(keys), "left_semi" if want else "left_anti").distinct()


def lookup_contacts(documents: DataFrame, lake: DataFrame, key: str, want: bool = True) -> DataFrame:
    """Contacts of the listed documents, or the documents the lake does not know.

    Misses are told apart by the lake side of the join, so a match list holds
    matches only.
    """
    wanted = documents.select(key).distinct()
    if want:
        return wanted.join(lake, key, "inner")
    return wanted.join(lake.select(key), key, "left_anti")


def new_only(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose composite key is not stored yet. Struct keys need no text concatenation."""
    return df.join(existing.select(*keys), list(keys), "left_anti")


def brand_dimension(spark, groups: Mapping[str, Sequence[str]] = fixed.BRAND_GROUPS) -> DataFrame:
    """(group, brand) rows of the brand groups, with implied brands added to each."""
    rows = [
        (group, brand)
        for group, brands in groups.items()
        for brand in [*brands, *[fixed.IMPLIED_BRANDS[b] for b in brands if b in fixed.IMPLIED_BRANDS]]
    ]
    return small_table(spark, {"grupo": [g for g, _ in rows], "marca": [b for _, b in rows]})


def chosen_brands(choices: Sequence[str], groups: Mapping[str, Sequence[str]] = fixed.BRAND_GROUPS) -> list[str]:
    """Lower-cased brands of a selection of groups and single brands, with the implied ones."""
    listed = [brand for choice in choices for brand in groups.get(choice, (choice,))]
    lowered = [brand.lower() for brand in listed]
    implied = [fixed.IMPLIED_BRANDS[brand] for brand in lowered if brand in fixed.IMPLIED_BRANDS]
    return list(dict.fromkeys([*lowered, *implied]))


def filter_groups(df: DataFrame, brand: str, groups: Sequence[str], dimension: DataFrame) -> DataFrame:
    """Rows whose lower-cased brand belongs to one of the groups, by semi-join on the dimension."""
    wanted = dimension.filter(F.col("grupo").isin(*groups)).select(F.col("marca").alias("_brand"))
    return df.join(wanted, F.lower(F.col(brand)) == F.col("_brand"), "left_semi")
