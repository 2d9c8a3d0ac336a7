"""Metric imports: wide tables to long rows, and their mapping to codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, metric_code, parse_float

# Names the import knows.
BUILT_IN = {"gdp": ("gdp_total", "亿元"), "地区生产总值": ("gdp_total", "亿元"), "常住人口": ("resident_population", "万人"), "resident_population": ("resident_population", "万人")}
YEAR_COLUMNS = ("stat_year", "year", "年份")


def is_long(columns: list[str]) -> bool:
    return {"indicator_code", "indicator_name", "stat_year"} <= set(columns)


def unpivot_wide(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """ids, indicator_name, value_text, value_numeric: a row for each cell that isn't empty."""
    long = rows.select(*ids, *[F.col(v).cast("string").alias(v) for v in values]).unpivot(ids, values, "indicator_name", "raw")
    long = long.withColumn("raw", clean_text(F.col("raw"))).where("raw is not null")
    return long.select(*ids, "indicator_name", F.when(parse_float(F.col("raw")).isNull(), F.col("raw")).alias("value_text"), parse_float(F.col("raw")).alias("value_numeric"))


def mapped(rows: DataFrame, user: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """With indicator_code and unit: the user's mapping, the built-in one by name, by lower-case name, or a code made of the name."""
    table = BUILT_IN | (user or {})
    codes = F.create_map(*[F.lit(x) for name, (code, _) in table.items() for x in (name, code)])
    units = F.create_map(*[F.lit(x) for name, (_, unit) in table.items() for x in (name, unit)])
    name = F.col("indicator_name")
    look = lambda m: F.coalesce(F.get(F.array(m[name]), F.lit(0)), m[F.lower(name)])
    return rows.withColumn("indicator_code", F.coalesce(look(codes), metric_code(name))).withColumn("unit", F.coalesce(look(units), F.lit("")))
