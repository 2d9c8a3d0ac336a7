"""A training-data pipeline over `documents`: each stage works on all that the one before kept.

Language ID drops documents without a language, MinHash keeps one document of each group of near
copies, secret scans mask secrets in the text, mixing orders what is left towards equal shares
of its sources, and the pieces of each text, in that order and with their mix_position, are
its last form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import crf_language, minhash_tensor, pfair_mix, secret_forest, unigram_pieces
from lodestone.llm.tables import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Documents with a language; `lang` is filled in where it is null. least: the smallest share of a document's words that its language must have.

    Where no document has a label nothing can be learned, and all are kept as they are. Repeated rows and
    ids are judged each for itself; an empty table stays empty.
    """
    crf = crf_language.train(docs, F.lit(True))
    if crf is None:
        return docs.select(*COLUMNS)
    found = crf_language.identify(docs, crf, keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != crf_language.UND) & (F.col("score") >= least))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8: the smallest id. Documents without an id are kept.

    An id that comes with different texts stands for several documents: each goes by a hash of id and
    text from 2^62 up, so it gives way to any smaller id it is a copy of, and what is no copy stays.
    Rows equal in id and text stay or go together; an empty table stays empty.
    m: a pair at 0.8 is a candidate with probability 0.9998.
    """
    seen = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    torn = keep(seen.where("lo <> hi").select("doc_id", F.lit(True).alias("torn")))
    keyed = docs.select(*COLUMNS, F.col("doc_id").alias("key"))
    if not torn.isEmpty():
        own = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
        keyed = docs.select(*COLUMNS).join(torn, "doc_id", "left").select(*COLUMNS, F.when(F.col("torn"), own).otherwise(F.col("doc_id")).alias("key"))
    found = minhash_tensor.minhash_clusters(keyed, id_col="key", percent=80, m=13, agree=0.55)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("key"))
    return keyed.join(gone, "key", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the text; n_chars follows."""
    return secret_forest.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def placed(docs: DataFrame) -> DataFrame:
    """docs with their mix_position, in its order. Every source has the same weight; the schedule follows from ids and sources alone, so it can be had again after any reread."""
    mix = pfair_mix.mix(docs, {}, rest=1)
    return mix.select(*COLUMNS, "mix_position").repartitionByRange("mix_position").sortWithinPartitions("mix_position")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, by position."""
    return placed(docs).select(*COLUMNS)


def positioned_pieces(docs: DataFrame) -> DataFrame:
    """doc_id, ids, mix_position: the text as pieces, in the order of the mix."""
    # the position goes along with the id
    named = placed(docs).select(F.struct("doc_id", "mix_position").alias("doc_id"), "text")
    return unigram_pieces.encode(named, unigram_pieces.load()).select("id.doc_id", "ids", "id.mix_position")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids: the text as pieces, in the order of the mix."""
    return positioned_pieces(docs).select("doc_id", "ids")


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("secrets", secrets), ("mixed", mixed), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return positioned_pieces(docs)
