"""Queue and trace bookkeeping as column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failed(jobs: DataFrame, which: Column) -> DataFrame:
    """Failure of the rows in `which`: back to pending with one more try while tries are left, else failed."""
    again = F.col("retry_count") < F.col("max_retries")
    status = F.when(which & again, "pending").when(which, "failed").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "retry_count": F.when(which & again, F.col("retry_count") + 1).otherwise(F.col("retry_count"))})


def succeeded(jobs: DataFrame, which: Column) -> DataFrame:
    return jobs.withColumns({"status": F.when(which, "success").otherwise(F.col("status")), "progress": F.when(which, 100).otherwise(F.col("progress"))})


def retried(jobs: DataFrame, which: Column) -> DataFrame:
    """Only failed jobs can be retried by hand."""
    return jobs.withColumn("status", F.when(which & (F.col("status") == "failed"), "pending").otherwise(F.col("status")))


def cancelled(jobs: DataFrame, which: Column) -> DataFrame:
    """Only pending jobs can be cancelled."""
    return jobs.withColumn("status", F.when(which & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")))


def stuck(jobs: DataFrame, now: Column, timeout_s: int = 120) -> Column:
    return (F.col("status") == "running") & (F.col("heartbeat_at") < now - F.expr(f"interval {timeout_s} seconds"))


def next_jobs(jobs: DataFrame, n: int = 1) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy("priority", "created_at", "job_id").limit(n)


def spans(rows: DataFrame, trace: str, order: str) -> DataFrame:
    """rows with span_order from 1 within a trace and the trace's next free order."""
    w = Window.partitionBy(trace)
    return rows.withColumn("span_order", F.row_number().over(w.orderBy(order))).withColumn("next_order", F.count(F.lit(1)).over(w) + 1)


def enqueued(jobs: DataFrame, fresh: DataFrame, now: Column, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """jobs with the fresh ones (job_id, job_type, priority, max_retries) as pending; a priority outside 0 to 1000, fewer than no retries or an unknown kind is an error."""
    priority = F.coalesce("priority", F.lit(100))
    wrong = (priority < 0) | (priority > 1000) | (F.coalesce("max_retries", F.lit(2)) < 0)
    wrong = wrong | ~F.col("job_type").isin(*kinds) if kinds else wrong
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("no such job: "), F.col("job_id").cast("string"))).cast("int")).otherwise(priority.cast("int"))
    rows = fresh.select("job_id", "job_type", checked.alias("priority"), F.coalesce("max_retries", F.lit(2)).alias("max_retries"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(0).alias("progress"), now.alias("created_at"))
    return jobs.unionByName(rows, allowMissingColumns=True)


def leased(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    """jobs with the next pending one running, locked by the worker. One writer at a time: Spark has no row locks."""
    next_ = next_jobs(jobs).select("job_id", F.lit(True).alias("_next"))  # one row
    mine = F.coalesce("_next", F.lit(False))
    held = {"locked_by": F.lit(worker), "locked_at": now, "heartbeat_at": now, "started_at": F.coalesce("started_at", now)}
    rows = jobs.join(next_, "job_id", "left")
    return rows.withColumns({"status": F.when(mine, "running").otherwise(F.col("status"))} | {c: F.when(mine, x).otherwise(F.col(c)) for c, x in held.items()}).select(*jobs.columns)


def tallies(rows: DataFrame, by: str, status: str) -> DataFrame:
    """by, result: how many rows have each status, as JSON with its keys in order."""
    counts = rows.groupBy(by, status).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(status, "n"))).alias("c"))
    return counts.select(by, F.to_json(F.map_from_entries("c")).alias("result"))
