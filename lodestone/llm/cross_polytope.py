"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A vector is scaled to unit length, padded to a power of two and passed through three rounds of
random signs and a fast Hadamard transform; the nearest signed axis is its hash. A bucket is
named by several such hashes of one table, the last of them over fewer axes, so that the number
of buckets grows with the rows (`width`). A query ranks buckets by the sum of its coordinates
along their axes and looks into the best `probes` of each table; what lies there is ranked
exactly.

For the inner product with vectors of unequal lengths the index is cut into ranges of lengths,
each within a factor of RATIO, and each range is an index of its own that every query probes:
within a range the direction decides, and a long vector changes nothing for the others. Ranges
of at most `few` vectors are put together and compared whole.

A table's buckets are dealt out in groups whose number grows with the rows; a query goes to the
groups that hold one of its buckets, and groups beyond `part_rows` are cut. Within a group each
bucket meets the queries that probe it as one matrix product, and only each query's best k go
on: candidates are never listed as pairs. A query that found fewer than k vectors is compared
with all.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components are
neither queries nor candidates; of rows with one id the smallest vector counts; null ids are
left out; only vectors of the commonest usable length (then the smallest) take part; only
where fewer than k others take part a query has fewer than k rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import lists
from .tables import keep
from .vectors import matrix, one_each, usable

RATIO = 1.1  # longest to shortest vector of a range
THIN = -1  # the range of all bands with few vectors


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def pseudo_rotation(x: np.ndarray, table: int, rounds: int = 3) -> np.ndarray:
    signs = np.random.Generator(np.random.PCG64([31, table])).choice([-1.0, 1.0], (rounds, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def width(rows: int, full: int) -> tuple[int, ...]:
    """Axes of each hash of a bucket's name: two hashes over all axes, then one over more and more as rows grow."""
    # a power of the rows under one: buckets get emptier to probe, not only more
    wanted = (max(rows, 2000) / 2000) ** 0.25
    return (full, full) if wanted < 2 else (full, full, min(full, 1 << int(np.log2(wanted))))


@lru_cache(16)
def _choices(counts: tuple[int, ...], probes: int) -> np.ndarray:
    """Ranks, hash by hash, of all buckets that can be among the best `probes`: a bucket has as many better ones as ranks below its own."""
    out = np.zeros((1, 0), np.int64)
    for n in counts:
        held = np.prod(out + 1, axis=1)
        out = np.concatenate([np.column_stack((out[held * (r + 1) <= probes], np.full(int((held * (r + 1) <= probes).sum()), r))) for r in range(min(n, probes))])
    return out


def buckets(x: np.ndarray, table: int, axes: tuple[int, ...], probes: int) -> np.ndarray:
    """Each unit vector's best buckets in a table, the best first."""
    out, at_once = np.empty((len(x), min(probes, int(np.prod([2.0 * a for a in axes])))), np.int64), 256
    for s in range(0, len(x), at_once):
        ranked = []
        for i, a in enumerate(axes):
            y = pseudo_rotation(x[s : s + at_once], table * 8 + i)[:, :a]
            y = np.concatenate((y, -y), axis=1)
            order = np.argsort(-y, axis=1, kind="stable")[:, : max(1, min(2 * a, probes))]
            ranked.append((order, np.take_along_axis(y, order, axis=1)))
        ranks = _choices(tuple(len(o[0]) for o, _ in ranked), probes)
        total, name = 0.0, 0
        for i, ((order, y), a) in enumerate(zip(ranked, axes, strict=True)):
            total, name = total + y[:, ranks[:, i]], name * (2 * a) + order[:, ranks[:, i]]
        n = out.shape[1]
        best = np.argsort(-total, axis=1, kind="stable")[:, :n] if n > 1 else np.argmax(total, axis=1)[:, None]
        out[s : s + at_once] = np.take_along_axis(name, best, axis=1)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, padded to a power of two."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    x = x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
    full = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, full - x.shape[1])))


def _placed(plan: dict[int, tuple[tuple[int, ...], int]], tables: int):
    """Each vector in its bucket of each table. plan: axes and groups by range."""

    def place(batches):
        for batch in batches:
            ranges = batch.column("range").to_numpy()
            for r in np.unique(ranges):
                rows = batch.filter(pa.array(ranges == r))
                axes, groups = plan[int(r)]
                x = unit(matrix(rows.column("v")))
                for table in range(tables):
                    name = buckets(x, table, axes, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([rows.column("range"), pa.array(np.full(len(x), table, np.int32)), pa.array((name % groups).astype(np.int32)), lists(name, np.ones(len(x), np.int64), pa.int64()), rows.column("id"), rows.column("v")], ["range", "t", "g", "buckets", "id", "v"])

    return place


def _probing(plan: dict[int, tuple[tuple[int, ...], int]], tables: int, probes: int):
    """Each query, once for each group that holds buckets it probes, with these."""

    def probe(batches):
        for whole in batches:
            for s in range(0, len(whole), 512):
                batch = whole.slice(s, 512)
                x = unit(matrix(batch.column("v")))
                for r, (axes, groups) in plan.items():
                    for table in range(tables):
                        name = buckets(x, table, axes, probes)
                        query, name = np.repeat(np.arange(len(x)), name.shape[1]), name.reshape(-1)
                        order = np.lexsort((name, name % groups, query))
                        query, name = query[order], name[order]
                        first = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (name[1:] % groups != name[:-1] % groups)))
                        at, n = query[first], len(first)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r, np.int32)), pa.array(np.full(n, table, np.int32)), pa.array((name[first] % groups).astype(np.int32)), lists(name, np.diff(np.append(first, len(name))), pa.int64()), batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at))], ["range", "t", "g", "buckets", "id", "v"])

    return probe


def _best(qid: np.ndarray, xid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of listed pairs."""
    order = np.lexsort((xid, -score, qid))
    qid, xid, score = qid[order], xid[order], score[order]
    best = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return qid[best], xid[best], score[best]


def _scored(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs that can be among each query's k best of x, itself left out: query ids, vector ids, scores."""
    for s in range(0, len(q), at_once):
        score = q[s : s + at_once] @ x.T
        score[qid[s : s + at_once][:, None] == xid[None, :]] = -np.inf
        near = score > -np.inf
        if len(x) > k:
            floor = np.partition(score, len(x) - k, axis=1)[:, len(x) - k]
            near &= score >= (floor - 1e-12 * (1 + np.abs(floor)))[:, None]
        i, j = np.nonzero(near)
        yield qid[s + i], xid[j], np.einsum("nd,nd->n", q[s + i], x[j])  # the same bits wherever the pair meets


def _ranked(k: int, at_once: int = 300_000):
    def rank(queries: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(held):
            q, x = matrix(queries.column("v").combine_chunks()), matrix(held.column("v").combine_chunks())
            qid, xid = queries.column("id").to_numpy(), held.column("id").to_numpy()
            lies = held.column("buckets").combine_chunks().flatten().to_numpy()
            order = np.argsort(lies, kind="stable")
            lies, x, xid = lies[order], x[order], xid[order]
            probed = queries.column("buckets").combine_chunks()
            many = pa.compute.list_value_length(probed).to_numpy()
            names, asks = probed.flatten().to_numpy(), np.repeat(np.arange(len(q)), many)
            order = np.argsort(names, kind="stable")
            names, asks = names[order], asks[order]
            pending = 0
            for b in np.intersect1d(names, lies):
                a = asks[slice(*np.searchsorted(names, [b, b + 1]))]
                lo, hi = np.searchsorted(lies, [b, b + 1])
                for part in _scored(q[a], qid[a], x[lo:hi], xid[lo:hi], k):
                    found.append(part)
                    pending += len(part[0])
                if pending > at_once:
                    found, pending = [_best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)], 0
        qid, xid, score = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
        return pa.table({"query_id": qid, "vec_id": xid, "score": score})

    return rank


def _lengths(batches):
    """The vectors with the logarithms of their lengths."""
    for batch in batches:
        if len(batch):
            sizes = batch.column("d").to_numpy()
            out = np.zeros(len(batch))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = matrix(batch.column("v").take(pa.array(at)))
                peak = np.abs(x).max(axis=1)  # squares of huge or tiny components stay finite
                x = x / peak[:, None]
                out[at] = np.log(peak) + np.log(np.einsum("nd,nd->n", x, x)) / 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("d"), pa.array(out)], ["id", "v", "d", "length"])


def nearest(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = 16, probes: int = 256, few: int = 512, part_rows: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found. queries: a condition on `id` (a Column)."""
    # single precision stays single while it is shuffled; all arithmetic is double
    held_as = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    usual = one_each(vectors, id_col, vector_col).where(usable("v")).select("id", F.col("v").cast(held_as).alias("v"), F.size("v").alias("d"))
    sound = keep(usual.mapInArrow(_lengths, f"id long, v {held_as}, d int, length double"))
    facts = sound.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("hi")).orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sound = sound.where(F.col("d") == facts["d"])
    full = 1 << max(0, facts["d"] - 1).bit_length()
    banded = sound.select("id", "v", F.floor((F.lit(facts["hi"]) - F.col("length")) / math.log(RATIO)).cast("int").alias("band"))
    # at most as many bands as doubles have powers of RATIO, some 15,000
    sizes = {r["band"]: r["n"] for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = {b: (width(n, full), -(-n // part_rows)) for b, n in sizes.items() if n > few}
    placed = banded.select(F.when(F.col("band").isin(*plan), F.col("band")).otherwise(THIN).alias("range"), "id", "v")
    asking = sound.where(queries).select("id", "v")
    schema = f"range int, t int, g int, buckets array<long>, id long, v {held_as}"
    # the range compared whole is a table of its own, with one bucket, which each query probes
    whole = (F.lit(THIN).alias("range"), F.lit(0).alias("t"), F.lit(0).alias("g"), F.array(F.lit(0).cast("long")).alias("buckets"), "id", "v")
    held = placed.where(F.col("range") == THIN).select(*whole)
    asked = asking.select(*whole)
    if plan:
        held = held.unionByName(placed.where(F.col("range") != THIN).mapInArrow(_placed(plan, tables), schema))
        asked = asked.unionByName(asking.mapInArrow(_probing(plan, tables, probes), schema))
    held = keep(held)
    # groups with many vectors (of one bucket, or of few) are cut
    by = ["range", "t", "g"]
    parts = held.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / (2 * part_rows)).cast("int").alias("parts"))
    held = held.join(parts, by).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    asked = asked.join(parts.select(*[F.col(c).alias(c) for c in parts.columns]), by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    by = [*by, "part"]
    result = "query_id long, vec_id long, score double"
    met = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_ranked(k), result)
    found = keep(met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    # queries that met fewer than k vectors, though there are more, are compared with all
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, facts["n"] - 1)).select(F.col("query_id").alias("id"))
    short = keep(asking.join(enough, "id", "left_anti"))
    if facts["n"] > 1 and not short.isEmpty():
        many = max(1, -(-facts["n"] // part_rows))
        every = sound.select(F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("part"), *whole[3:])
        lacking = short.select(F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("part"), *whole[3:])
        found = found.union(lacking.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(_ranked(k), result)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_cross_polytope(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
