"""Imports of dataset catalogues and metric files into keyed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, enum_or, parse_bool, parse_date, parse_float, parse_int
from ..sources.tabular import ARRIVAL
from .metrics import YEAR_COLUMNS, is_long, mapped, unpivot_wide
from .upsert import counters, one_a_key, upsert

# Columns of the catalogue file that have a place of their own.
CATALOG = ("dataset_name", "description", "category", "department", "owner", "source_platform", "source_url", "open_type", "update_frequency", "update_date", "time_range", "region_level", "sensitivity_level", "download_count", "api_count")
DOMAINS = ("economy", "population", "open_data", "other")
PERIODS = ("annual", "quarterly", "monthly")
# Columns of a wide metric file that are no metrics.
WIDE_DIMENSIONS = ("stat_year", "year", "年份", "region_code", "region_name", "地区", "stat_period", "source", "source_url", "data_version")
METRIC_KEYS = ["indicator_code", "region_code", "stat_period", "stat_year", "stat_month", "data_version"]


def _given(rows: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")


def _row(rows: DataFrame) -> Column:
    """The place of a row in its file: what the reader numbered, else the order of the frame as it is read."""
    return (F.col(ARRIVAL) if ARRIVAL in rows.columns else F.monotonically_increasing_id()).alias("_row")


def extras(rows: DataFrame, known: tuple[str, ...]) -> Column:
    """The other columns as JSON, empty cells left out."""
    names = [c for c in rows.columns if c not in known and c != ARRIVAL]
    if not names:
        return F.lit("{}")
    cells = F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return F.to_json(F.map_filter(cells, lambda _, v: v.isNotNull()))


def catalogue_rows(raw: DataFrame) -> DataFrame:
    """Typed rows of a catalogue file; a bad number, truth value or date is an error."""
    texts = [clean_text(_given(raw, c)).alias(c) for c in CATALOG if c not in ("update_date", "download_count", "api_count")]
    return raw.select(*texts, parse_date(_given(raw, "update_date")).alias("update_date"), parse_int(_given(raw, "download_count")).alias("download_count"), parse_int(_given(raw, "api_count")).alias("api_count"), extras(raw, CATALOG).alias("metadata"), _row(raw)).where("dataset_name is not null")


@dataclass
class Imported:
    tables: dict[str, DataFrame]
    counts: dict[str, DataFrame]


def import_datasets(target: DataFrame, fields: DataFrame, raw: DataFrame, raw_fields: DataFrame) -> Imported:
    """Datasets by (dataset_name, source_url), fields by the dataset and field_name; the last row of a key counts.

    Fields go to the file's last dataset of that name, whatever its source_url; those without a name or of a dataset that the file lacks are left out and counted. Fields held without a source_url belong to the dataset without one.
    """
    columns = [c for c in CATALOG if c not in ("dataset_name", "source_url")] + ["metadata"]
    rows = one_a_key(catalogue_rows(raw), ["dataset_name", "source_url"], "_row")
    datasets = upsert(target, rows, ["dataset_name", "source_url"], columns)
    typed = raw_fields.select(
        *[clean_text(_given(raw_fields, c)).alias(c) for c in ("dataset_name", "field_name", "field_type", "description", "example_value")],
        parse_bool(_given(raw_fields, "is_dimension")).alias("is_dimension"), parse_bool(_given(raw_fields, "is_measure")).alias("is_measure"), _row(raw_fields),
    )
    known = rows.groupBy("dataset_name").agg(F.max_by("source_url", "_row").alias("source_url"), F.lit(True).alias("_known"))
    held = fields if "source_url" in fields.columns else fields.withColumn("source_url", F.lit(None).cast("string"))
    keys = ["dataset_name", "source_url", "field_name"]
    joined = typed.join(known, "dataset_name", "left")
    usable = joined.where("_known and field_name is not null").drop("_known")
    merged = upsert(held, one_a_key(usable, keys, "_row"), keys, ["field_type", "description", "example_value", "is_dimension", "is_measure"])
    skipped = joined.agg(F.count_if(F.col("_known").isNull() | F.col("field_name").isNull()).alias("skipped"))
    return Imported({"datasets": datasets, "fields": merged}, {"datasets": counters(datasets), "fields": counters(merged), "skipped": skipped})


def _period(x: Column, fallback: str) -> Column:
    """A row's own period, else the fallback; an unknown one is an error."""
    given = clean_text(x)
    return F.when(given.isNull(), F.lit(fallback)).when(given.isin(*PERIODS), given).otherwise(F.raise_error(F.concat(F.lit("not a period: "), given)).cast("string"))


def metric_rows(raw: DataFrame, region_code: str | None = None, region_name: str | None = None, data_version: str = "default", period: str = "annual") -> DataFrame:
    """Rows of a long or wide metric file in one shape."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period}")
    number = _row(raw)
    default = lambda c, v: F.coalesce(clean_text(_given(raw, c)), F.lit(v).cast("string")).alias(c)
    if is_long(raw.columns):
        rows = raw.select(
            clean_text(F.col("indicator_code")).alias("indicator_code"), clean_text(F.col("indicator_name")).alias("indicator_name"), enum_or(F.coalesce(_given(raw, "domain"), F.lit("other")), DOMAINS, "other").alias("domain"),
            default("region_code", region_code), default("region_name", region_name), _period(_given(raw, "stat_period"), period).alias("stat_period"), parse_int(F.col("stat_year")).cast("int").alias("stat_year"), parse_int(_given(raw, "stat_month")).cast("int").alias("stat_month"),
            parse_float(_given(raw, "value_numeric")).alias("value_numeric"), clean_text(_given(raw, "value_text")).alias("value_text"), F.coalesce(clean_text(_given(raw, "unit")), F.lit("")).alias("unit"), default("data_version", data_version), number,
        )
        rows = rows.withColumn("stat_month", F.nullif("stat_month", F.lit(0)))
        return rows.where("indicator_code is not null and indicator_name is not null")
    year = next((c for c in YEAR_COLUMNS if c in raw.columns), None)
    if year is None:
        raise ValueError("a wide file needs a year column")
    values = [c for c in raw.columns if c not in WIDE_DIMENSIONS and c != ARRIVAL]
    place = F.coalesce(clean_text(_given(raw, "region_name")), clean_text(_given(raw, "地区")), F.lit(region_name).cast("string")).alias("region_name")
    ids = ["stat_year", "region_code", "region_name", "stat_period", "data_version", "_row"]
    wide = raw.select(parse_int(F.col(f"`{year}`")).cast("int").alias("stat_year"), default("region_code", region_code), place, _period(_given(raw, "stat_period"), period).alias("stat_period"), default("data_version", data_version), number, *[F.col(f"`{v}`") for v in values])
    long = mapped(unpivot_wide(wide, ids, values))
    return long.select("indicator_code", "indicator_name", F.lit("other").alias("domain"), "region_code", "region_name", "stat_period", "stat_year", F.lit(None).cast("int").alias("stat_month"), "value_numeric", "value_text", "unit", "data_version", "_row")


def import_metrics(metrics: DataFrame, values: DataFrame, raw: DataFrame, **options) -> Imported:
    """Metrics by code (a file's first row counts), values by their key (its last row counts); rows of a long file without code or name are left out and counted."""
    rows = metric_rows(raw, **options)
    heads = one_a_key(rows.select("indicator_code", "indicator_name", "domain", "unit", "_row"), ["indicator_code"], "_row", last=False)
    cells = one_a_key(rows.select(*METRIC_KEYS, "region_name", "value_numeric", "value_text", "unit", "_row"), METRIC_KEYS, "_row")
    out_metrics = upsert(metrics, heads, ["indicator_code"], ["indicator_name", "domain", "unit"])
    out_values = upsert(values, cells, METRIC_KEYS, ["region_name", "value_numeric", "value_text", "unit"])
    unnamed = F.count_if(clean_text(F.col("indicator_code")).isNull() | clean_text(F.col("indicator_name")).isNull()) if is_long(raw.columns) else F.lit(0).cast("bigint")
    return Imported({"metrics": out_metrics, "values": out_values}, {"metrics": counters(out_metrics), "values": counters(out_values), "skipped": raw.agg(unnamed.alias("skipped"))})
