"""Keyed upserts as joins: no table format with MERGE is needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_a_key(rows: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """The last (or first) row of each key by `order`."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], only_changes: bool = False) -> DataFrame:
    """Target after the source, with _op: created, updated or kept. Keys meet null-safely; an incoming null replaces what was there.

    only_changes: a matched row counts as updated only if a column differs.
    """
    t = target.select(*keys, *columns).withColumn("_t", F.lit(True)).alias("t")
    s = source.select(*keys, *columns).withColumn("_s", F.lit(True)).alias("s")
    joined = t.join(s, reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]), "full_outer")
    incoming = F.col("s._s").isNotNull()
    differs: Column = reduce(lambda a, b: a | b, [~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns]) if only_changes else F.lit(True)
    op = F.when(F.col("t._t").isNull(), "created").when(incoming & differs, "updated").otherwise("kept")
    picked = [F.when(incoming, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in [*keys, *columns]]
    return joined.select(*picked, op.alias("_op"))


def counters(upserted: DataFrame) -> DataFrame:
    return upserted.groupBy("_op").agg(F.count(F.lit(1)).alias("n"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def reused(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_semi")


def first_by_hash(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """One row for each distinct content: the first by `order`, with content_hash and how many copies there are."""
    return rows.withColumn("content_hash", F.sha2(content.cast("binary"), 256)).groupBy("content_hash").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
