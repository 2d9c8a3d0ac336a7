"""Reading inputs and cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set and Spark runs in this process alone (tests), a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that came from `keep` and that nothing reads any more."""
    spark = df.sparkSession
    jvm, base = spark.sparkContext._jvm, shared_dir(spark).split("://")[-1].split(":")[-1]
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if base in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo `parts`: the fold that the query contracts name."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts)


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator uses: others can't clash."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])
