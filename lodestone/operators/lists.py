"""Lists: filters, stable orders and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyword_filter(rows: DataFrame, keyword: str, columns: list[str]) -> DataFrame:
    """Rows that hold the keyword in some column, case apart; '%' and '_' in it are wildcards."""
    return rows.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{keyword}%") for c in columns])) if keyword else rows


def all_of(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every condition that is given."""
    for condition in conditions:
        if condition is not None:
            rows = rows.where(condition)
    return rows


def paged(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The page from 1 in a total order; `total` is the number of rows before paging."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
