"""Merges by key: outer, with a default, by priority; and what is written about a group: ordered names, a sign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both sides, together where they share the keys."""
    return a.join(b, keys, "full_outer")


def looked_up(df: DataFrame, keys: list[str], table: DataFrame, value: str, default) -> DataFrame:
    """The rows with `value` of the table that has one row a key, or the default where it has none."""
    return df.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def first_known(df: DataFrame, keys: list[str], updates: list[DataFrame], value: str, default) -> DataFrame:
    """The rows with `value` of the first of the updates that knows it, or the default; each update has one row a key."""
    names = []
    for i, update in enumerate(updates):
        names.append(f"_{value}_{i}")
        df = df.join(update.select(*keys, F.col(value).alias(names[-1])), keys, "left")
    return df.withColumn(value, F.coalesce(*names, F.lit(default))).drop(*names)


def ordered_names(pairs: Column, separator: str = ",") -> Column:
    """Distinct (order, name) of an array, names joined in order."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(pairs)), lambda x: x["name"]), separator)


def sign(total: Column) -> Column:
    return F.when(total > 0, "+").when(total < 0, "-").otherwise(".")


def sorted_rows(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows in order over all partitions: dealt by ranges, then sorted within, so that no task sees them all."""
    return (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
