"""Traces of questions as a sink: spans arrive in batches, and a batch that comes again leaves them once.

Each batch of a stream writes a folder of its own under its number and overwrites it when it is
replayed, so a failure between a batch's write and its checkpoint repeats nothing. Spans that
another batch has already (same trace and order) are passed over. Spans without an order get the
next free ones of their trace, by time. Traces are dealt to `buckets` folders by hash, so a batch
looks only into the folders of its own traces.

Defined cases: rows without a trace or a kind are left out; negative latencies count as 0; of spans of
one trace and order in a batch the first by time and name counts; a trace whose header never came
has its spans and null header columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import exists

EVENT = "trace_id long, kind string, ts timestamp, span_order int, span_type string, status string, latency_ms long, user_id long, question string, route string, answer string"
SPANS = "trace_id long, span_order int, span_type string, status string, latency_ms long, ts timestamp, bucket int, batch long"
HEADERS = "trace_id long, kind string, ts timestamp, status string, latency_ms long, user_id long, question string, route string, answer string, batch long"


@dataclass
class TraceSink:
    """kind of an event: start (user_id, question), span (span_order or null, span_type, status, latency_ms), finish (route, answer, status, latency_ms)."""

    spark: SparkSession
    path: str
    buckets: int = 16

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """One batch, for `foreachBatch`."""
        latency = F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(0)).alias("latency_ms")
        rows = rows.where("trace_id is not null and kind is not null").withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(self.buckets)).cast("int"))
        heads = rows.where("kind in ('start', 'finish')").select("trace_id", "kind", "ts", "status", latency, "user_id", "question", "route", "answer")
        spans = rows.where("kind = 'span'").select("trace_id", "span_order", "span_type", "status", latency, "ts", "bucket")
        # at most `buckets` rows
        touched = [r["bucket"] for r in spans.select("bucket").distinct().collect()]
        old = self._read("spans", SPANS).where(F.col("bucket").isin(*touched) & (F.col("batch") != batch_id))
        known = old.groupBy("trace_id").agg(F.max("span_order").alias("top"))
        given = Window.partitionBy("trace_id", "span_order").orderBy("ts", "span_type", "status", "latency_ms")
        placed = spans.where("span_order is not null").withColumn("_n", F.row_number().over(given)).where("_n = 1").drop("_n")
        placed = placed.join(old.select("trace_id", "span_order"), ["trace_id", "span_order"], "left_anti")
        told = placed.groupBy("trace_id").agg(F.max("span_order").alias("here"))
        line = Window.partitionBy("trace_id").orderBy("ts", "span_type", "status", "latency_ms")
        free = spans.where("span_order is null").withColumn("at", F.row_number().over(line)).join(known, "trace_id", "left").join(told, "trace_id", "left")
        free = free.withColumn("span_order", F.greatest(F.coalesce("top", F.lit(0)), F.coalesce("here", F.lit(0))) + F.col("at")).select(placed.columns)
        self._put(placed.unionByName(free), "spans", batch_id, ["batch", "bucket"])
        self._put(heads, "headers", batch_id, ["batch"])

    def _put(self, rows: DataFrame, name: str, batch_id: int, folders: list[str]) -> None:
        # rows are worked out anew in a replay, so the folder of its batch holds the same again
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{self.path}/{name}")

    def stream(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Everything there is now; a later call goes on from the checkpoint."""
        return events.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def spans(self) -> DataFrame:
        return self._read("spans", SPANS).drop("bucket")

    def headers(self) -> DataFrame:
        """A row a trace: running until a finish came; of several the latest counts."""
        last = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.struct("ts", column)))[column]
        one = self._read("headers", HEADERS).groupBy("trace_id").agg(
            last("start", "user_id").alias("user_id"), last("start", "question").alias("question"), F.coalesce(last("finish", "status"), F.lit("running")).alias("status"),
            last("finish", "route").alias("route"), last("finish", "answer").alias("answer"), last("finish", "latency_ms").alias("latency_ms"),
        )
        return one

    def joined(self) -> DataFrame:
        """Headers with spans (in order), n_spans and span_ms."""
        listed = self.spans().groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("span_order", "span_type", "status", "latency_ms"))).alias("spans"), F.count(F.lit(1)).alias("n_spans"), F.sum("latency_ms").alias("span_ms"))
        return self.headers().join(listed, "trace_id", "full")


def events_of(spark: SparkSession, trace_id: int, user_id: int | None, question: str, answer, at) -> DataFrame:
    """The events of one answered question (see `plans.ask.Answer`)."""
    rows = [(trace_id, "start", at, None, None, "running", 0, user_id, question, None, None)]
    rows += [(trace_id, "span", at, i, name, status, ms, None, None, None, None) for i, (name, status, ms) in enumerate(answer.spans, 1)]
    rows.append((trace_id, "finish", at, None, None, answer.status, sum(ms for _, _, ms in answer.spans), None, None, answer.route, "\n".join(answer.evidence)))
    return spark.createDataFrame(rows, EVENT)
