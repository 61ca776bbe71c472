"""The first rows of each group, cut before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, keys: list[str], order: list[Column | str], most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each group, with their rank from 1.

    A rank that is cut off at a constant is a group limit: each task keeps its own first
    rows of a group and only these are shuffled, so no group comes together whole.
    """
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most)


def first_values(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, most: int) -> DataFrame:
    """keys with an array, named as the value: those of the first `most` rows, in order."""
    head = first_rows(rows.select(*keys, *[c for c in order if isinstance(c, str) and c != value], value), keys, order, most, "_rank")
    held = F.transform(F.array_sort(F.collect_list(F.struct("_rank", value))), lambda x: x[value])
    return head.groupBy(*keys).agg(held.alias(value))
