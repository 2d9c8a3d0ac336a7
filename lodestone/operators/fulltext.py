"""An inverted index as tables: what has been indexed is never read again to answer a query.

Under one folder:

* `postings` (bucket, term, doc, batch, tf, length, positions): a row for each term of each text. Terms
  are dealt to `buckets` folders by checksum, and within a folder rows are sorted by term, so a
  query opens its terms' folders and, by the statistics of Parquet, its terms' row groups. A term
  that most texts hold is split by document on the way there, so no task gets it whole.
* `documents` (doc, batch, hash, length): what was indexed, and by which batch.
* `superseded` (doc, batch, length): versions that a later batch replaced. Only texts that changed are here.
* `batches` (batch, texts, words, gone, gone_words): a row for each batch that was written whole, and
  written last. Readers go by it, so a batch that failed half way is never seen.

`add` indexes what is new or changed; the same batch of texts again adds nothing. Queries are
conjunctions: the texts that hold every term, ranked by BM25.

Defined cases: a null text has no terms and is indexed as empty; of several texts of one id in a
batch the one with the smallest hash counts; rows without an id are left out; a query without a
term finds nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, removed, written

TOKEN = r"[\p{L}\p{N}\p{M}_]+"
K1, B = 1.2, 0.75
SPLITS = 64  # tasks that a bucket's postings are dealt to on the way
WORDS = 1 << 20  # words whose postings a task gathers at a time


def terms_in(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def query_terms(query: str) -> list[str]:
    """Words of a query at hand, once each."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (doc, words): a row for each term of each, with where it stands. By term, so that neighbours are alike."""
    for batch in batches:
        ends = np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(batch):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + WORDS, "right")))
            some = batch.slice(first, last - first)
            length = np.diff(ends[first:last], prepend=before)
            held = some.column("words").flatten().dictionary_encode()
            text = np.repeat(np.arange(len(some)), length)
            position = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
            key = held.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(some) + text
            order = np.argsort(key, kind="stable")
            key = key[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            of = text[order[start]]
            places = pa.ListArray.from_arrays(pa.array(np.r_[start, len(key)], pa.int32()), pa.array(position[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([held.dictionary.take(pa.array(key[start] // len(some))), some.column("doc").take(pa.array(of)), pa.array(length[of], pa.int32()), places], ["term", "doc", "length", "positions"])
            first = last


@dataclass
class Index:
    spark: SparkSession
    path: str
    buckets: int = 64

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    @property
    def batches(self) -> dict[int, dict]:
        """A row for each call of `add` that ended well."""
        return {r["batch"]: r.asDict() for r in self._table("batches", "batch int, texts long, words long, gone long, gone_words long").collect()}

    def _whole(self, name: str, schema: str) -> DataFrame:
        return self._table(name, f"{schema}, part int").where(F.col("part").isin(*self.batches)).drop("part")

    @property
    def superseded(self) -> DataFrame:
        return self._whole("superseded", "doc long, batch int, length int")

    @property
    def documents(self) -> DataFrame:
        """Texts that count."""
        return self._current(self._whole("documents", "doc long, batch int, hash string, length int"))

    @property
    def postings(self) -> DataFrame:
        """Postings of the texts that count."""
        return self._current(self._whole("postings", "term string, doc long, batch int, tf int, length int, positions array<int>, bucket int"))

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows without superseded ones: only those of batches that have such are compared with them."""
        gone = self.superseded
        # a number for each batch
        partly = [r["batch"] for r in gone.select("batch").distinct().collect()]
        if not partly:
            return rows
        old = F.col("batch").isin(partly)
        return rows.where(~old).unionByName(rows.where(old).join(gone.select("doc", "batch"), ["doc", "batch"], "left_anti"))

    def bucket(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.buckets

    def add(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Index what is new or changed; returns the batch's number. One writer at a time."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = texts.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("hash")).where("doc is not null")
        known = self.batches
        batch = max(known, default=0) + 1
        while exists(self.spark, f"{self.path}/words/batch={batch}"):  # what a failed batch left
            batch += 1
        # texts themselves stay where they are read: what is new is told by hashes
        told = rows.select("doc", F.struct("hash", F.size(terms_in(F.col("text"))).alias("length")).alias("t")).groupBy("doc").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("rows"))
        told = told.select("doc", "t.hash", "t.length", "rows")
        if known:
            have = self.documents.select("doc", F.col("hash").alias("had"), F.col("batch").alias("old"), F.col("length").alias("old_length"))
            told = told.join(have, "doc", "left").where("had is null or had <> hash").drop("had")
        else:
            told = told.withColumns({c: F.lit(None).cast("int") for c in ("old", "old_length")})
        fresh = written(told, f"{self.path}/words/batch={batch}")
        sums = [F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.count("old"), F.coalesce(F.sum("old_length"), F.lit(0))]
        counts = fresh.agg(*sums).toDF("texts", "words", "gone", "gone_words").select(F.lit(batch).alias("batch"), *[F.col(c).cast("long").alias(c) for c in ("texts", "words", "gone", "gone_words")])
        fresh.select("doc", F.lit(batch).alias("batch"), "hash", "length").write.mode("append").parquet(f"{self.path}/documents/part={batch}")
        fresh.where("old is not null").select("doc", F.col("old").alias("batch"), F.col("old_length").alias("length")).write.mode("append").parquet(f"{self.path}/superseded/part={batch}")
        if known:
            rows = rows.join(fresh.select("doc", "hash"), ["doc", "hash"], "left_semi")
        if fresh.where("rows > 1").limit(1).count():
            # ids with several rows: one text of each
            several = written(fresh.where("rows > 1").select("doc", "hash"), f"{self.path}/words/batch={batch}/several")
            again = rows.join(several, ["doc", "hash"], "left_semi").dropDuplicates(["doc", "hash"])
            rows = rows.join(several.select("doc"), "doc", "left_anti").unionByName(again)
        found = rows.select("doc", terms_in(F.col("text")).alias("words")).mapInArrow(_postings, "term string, doc long, length int, positions array<int>")
        found = found.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int")).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(SPLITS)))
        found = found.sortWithinPartitions("bucket", "term", "doc").select("term", "doc", F.lit(batch).alias("batch"), F.size("positions").alias("tf"), "length", "positions", "bucket")
        found.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings/part={batch}")
        counts.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        removed(self.spark, f"{self.path}/words/batch={batch}")
        return batch

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The terms' postings: only their buckets are opened."""
        buckets = sorted({self.bucket(t) for t in terms})
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """term, df (texts that hold it), tf (its occurrences)."""
        rows = self.postings if terms is None else self.of_terms(terms)
        return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))

    def _counts(self) -> tuple[int, float]:
        n, words = (sum(b[c] - b[g] for b in self.batches.values()) for c, g in (("texts", "gone"), ("words", "gone_words")))
        return n, words / max(n, 1)

    def search(self, query: str, k: int | None = 20) -> DataFrame:
        """doc, score: texts with every term of the query by BM25, ties to smaller ids. k None: all of them."""
        terms = query_terms(query)
        # one row a term of the query
        df = {r["term"]: r["df"] for r in self.frequencies(terms).collect()} if terms else {}
        if not terms or len(df) < len(terms):
            return self.spark.createDataFrame([], "doc long, score double")
        n, mean = self._counts()
        rarest = min(terms, key=lambda t: df[t])
        rows = self.of_terms(terms).drop("positions")
        if len(terms) > 1:
            # other terms' postings are cut down to the texts of the rarest before they are grouped
            rows = rows.join(self.of_terms([rarest]).select("doc"), "doc", "left_semi")
        idf = F.create_map(*[F.lit(x) for t in terms for x in (t, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))])
        weight = idf[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
        found = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("held"), F.round(F.sum(weight), 6).alias("score")).where(F.col("held") == len(terms)).drop("held")
        return found if k is None else found.orderBy(F.desc("score"), "doc").limit(k)

    def phrase(self, words: str) -> DataFrame:
        """doc, n: texts that hold the words one after the other, and how often."""
        asked = re.findall(r"\w+", words.lower())
        if not asked:
            return self.spark.createDataFrame([], "doc long, n int")
        places = [F.array(*[F.lit(i) for i, w in enumerate(asked) if w == t]) for t in dict.fromkeys(asked)]
        at = F.create_map(*[x for t, p in zip(dict.fromkeys(asked), places, strict=True) for x in (F.lit(t), p)])
        # where the phrase would start, by each of its words
        starts = self.of_terms(list(dict.fromkeys(asked))).select("doc", F.explode(at[F.col("term")]).alias("i"), "positions")
        starts = starts.select("doc", F.transform("positions", lambda p: p - F.col("i")).alias("starts"))
        held = starts.groupBy("doc").agg(F.collect_list("starts").alias("s")).where(F.size("s") == len(asked))
        common = F.aggregate(F.slice("s", 2, len(asked)), F.col("s")[0], lambda a, x: F.array_intersect(a, x))
        return held.select("doc", F.size(common).alias("n")).where("n > 0")
