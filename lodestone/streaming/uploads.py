"""Uploads as a stream: each content is stored once, and every upload is told which file holds its content.

The rule is the one of a table with a unique hash: the first upload of a content makes a file, later
ones get that file back, however late they come. `once` is the form without a table: a stream drops
repeats that come within the watermark, with state for that span of time only.

Each batch writes folders under its number and overwrites them when it is replayed. Hashes are dealt to
`buckets` folders, so a batch reads only the hashes of its own buckets, never contents.

Defined cases: uploads without content or id are left out, an empty content is a content; of equal
contents in a batch the first by time and id makes the file (a null time comes last); an upload_id that
comes twice in a batch gets one answer a row; extra columns are not kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import exists

FILES = "file_hash string, file_id string, ts timestamp, batch long, bucket int"
ANSWERS = "upload_id string, file_hash string, file_id string, reused boolean, batch long"


def _hash(content: str) -> Column:
    return F.sha2(F.col(content).cast("binary"), 256)


def once(uploads: DataFrame, content: str = "content", late: str = "1 hour") -> DataFrame:
    """uploads with file_hash, repeats left out: in a stream all that come within `late` of the first and perhaps later ones (state is let go behind the watermark), in a batch all. Rows without content go."""
    hashed = uploads.where(F.col(content).isNotNull()).withColumn("file_hash", _hash(content))
    return hashed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file_hash"]) if uploads.isStreaming else hashed.dropDuplicates(["file_hash"])


@dataclass
class UploadStore:
    """Uploads are rows of upload_id, ts, content."""

    spark: SparkSession
    path: str
    buckets: int = 16

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def _put(self, rows: DataFrame, name: str, batch_id: int, folders: list[str]) -> None:
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{self.path}/{name}")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """One batch, for `foreachBatch`. Contents stay where they are read: hashes are what moves."""
        hashed = rows.where("content is not null and upload_id is not null").select(F.col("upload_id").cast("string").alias("upload_id"), F.col("ts").cast("timestamp").alias("ts"), _hash("content").alias("file_hash"))
        hashed = hashed.withColumn("bucket", F.pmod(F.xxhash64("file_hash"), F.lit(self.buckets)).cast("int"))
        first = hashed.groupBy("file_hash", "bucket").agg(F.min(F.struct(F.col("ts").isNull().alias("n"), "ts", "upload_id")).alias("f"))
        first = first.select("file_hash", F.col("f.upload_id").alias("file_id"), "f.ts", "bucket")
        # at most `buckets` rows
        touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]
        old = self._read("files", FILES).where(F.col("bucket").isin(*touched) & (F.col("batch") != batch_id)).select("file_hash", "file_id")
        self._put(first.join(old, "file_hash", "left_anti"), "files", batch_id, ["batch", "bucket"])
        # read back, so that the answers name the files that were written
        held = self._read("files", FILES).where(F.col("bucket").isin(*touched) & (F.col("batch") <= batch_id)).select("file_hash", "file_id", (F.col("batch") < batch_id).alias("_before"))
        found = hashed.join(held, "file_hash").withColumn("reused", F.col("_before") | (F.col("upload_id") != F.col("file_id")))
        self._put(found.select("upload_id", "file_hash", "file_id", "reused"), "answers", batch_id, ["batch"])

    def stream(self, uploads: DataFrame, checkpoint: str) -> StreamingQuery:
        """Everything there is now; a later call goes on from the checkpoint. Batches of one store come from one stream, so their numbers rise."""
        return uploads.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def files(self) -> DataFrame:
        return self._read("files", FILES).drop("bucket")

    def answers(self) -> DataFrame:
        return self._read("answers", ANSWERS)
