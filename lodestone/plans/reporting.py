"""The reporting views over curated tables, and their field catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def value_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly order value by region: the analogue of the yearly indicator views."""
    orders, customer, nation, region = tables(spark, sf_dir, "orders", "customer", "nation", "region")
    # nation and region are code lists of fixed size
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    by = joined.groupBy(F.col("r_regionkey").cast("bigint").alias("region_code"), F.col("r_name").alias("region_name"), F.year("o_orderdate").cast("bigint").alias("stat_year"))
    return by.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value_numeric"), F.count(F.lit(1)).alias("n_orders")).withColumn("indicator_name", F.lit("order_value")).withColumn("unit", F.lit("USD"))


def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("dataset_name"), F.col("lang").alias("category"), F.col("source").alias("department"), F.col("n_chars").alias("api_count"))


def _stats(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    return dataset_catalog(spark, sf_dir).groupBy(by).agg(F.count(F.lit(1)).alias("dataset_count"), F.coalesce(F.sum("api_count"), F.lit(0)).alias("api_count"), F.max("api_count").alias("latest"))


def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "category")


def department_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "department")


VIEWS = {"vw_value_yearly": value_yearly, "vw_dataset_catalog": dataset_catalog, "vw_category_stats": category_stats, "vw_department_stats": department_stats}


def publish(spark: SparkSession, sf_dir: str, schema: str = "reporting") -> None:
    """Temporary views `reporting_<view>` of this session; the guard maps `reporting.<view>` onto them."""
    for name, view in VIEWS.items():
        view(spark, sf_dir).createOrReplaceTempView(f"{schema}_{name}")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view_name, position, field_name, field_type of every reporting view."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, view in VIEWS.items() for i, f in enumerate(view(spark, sf_dir).schema)]
    return spark.createDataFrame(rows, "view_name string, position int, field_name string, field_type string")
