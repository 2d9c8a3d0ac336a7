"""MinHash near-dedup by tensored banding.

A document's set is its distinct five-word shingles (64-bit hashes of A-Z-lower-cased words
`[^\\x20\\x09-\\x0D]+`); with one to four words, the whole sequence is the one shingle; with none
the set is empty. Two small collections of `m` keys of `r` minhashes each are computed; every
pair of a key of one and a key of the other is a table key, so `m * m` tables of `2 * r` rows
cost `2 * m * r` minhashes. Candidates are confirmed on full sets.

Keys of a collection that only one set has are left out before pairs are made.

Equal sets fall together first, by 128 bits of set fingerprint and the set's size. In a bucket,
documents are compared with one representative (the best connected one). Where a bucket still
holds different components, its documents meet again, in parts of bounded size, two parts at a
time, in the buckets of one key collection (which hold every tensored bucket); a task confirms
pairs of different components whose signatures allow the similarity, and returns a spanning
forest of its links: pairs are never listed, and no link between two components is lost.

Defined cases: null, empty or blank texts have n_shingles 0, link with nothing and are kept;
rows with equal doc_id count as one document, that with the smallest (n_shingles, fingerprint);
null doc_ids are left out; rows that repeat give one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .packed import U, gram, LOWER, lists, mixed, packs, sums, words
from .tables import discard, keep, narrowed

SIGNATURE = "id long, n_shingles long, f1 long, f2 long, left array<long>, right array<long>, bits array<long>"


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, repeats included, one text after the other, and how many each has."""
    start, end, n = words(buf, offsets)
    w = gram(sums(LOWER[buf]), start, end)
    first = np.cumsum(n) - n
    many = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    if not len(w):
        return w, many
    owner = np.repeat(np.arange(len(n)), many)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(n, width)[owner]
    total = np.zeros(len(at), U)
    for i in range(width):
        part = mixed(w[np.minimum(at + i, len(w) - 1)] + U(2 * i + 1)) * U(0x9E3779B97F4A7C15 + 2 * i)
        part[size <= i] = 0
        total += part
    return mixed(total + size.astype(U)), many


def distinct_shingles(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As `shingles`, distinct within each text and sorted."""
    x, many = shingles(buf, offsets, width)
    ends = np.cumsum(many)
    for i in np.flatnonzero(many > 1):
        x[ends[i] - many[i] : ends[i]].sort()
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    first[(ends - many)[many > 0]] = True
    return x[first], np.add.reduceat(np.append(first, False), np.minimum(ends - many, len(x))).astype(np.int64) * (many > 0)


def fingerprints(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its shingles."""
    f1, f2 = np.zeros(len(n), U), np.zeros(len(n), U)
    if len(x):
        at = (np.cumsum(n) - n)[n > 0]
        f1[n > 0] = np.add.reduceat(mixed(x + U(1)), at)
        f2[n > 0] = np.add.reduceat(mixed(x ^ U(0xA5A5A5A5A5A5A5A5)), at)
    return f1, f2


def _signer(m: int, r: int, width: int):
    seeds = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 63, 4 * m * r, dtype=np.uint64)
    factor, shift = seeds[: 2 * m * r] * U(2) + U(1), seeds[2 * m * r :]

    def sign(batches):
        for rows, buf, offsets in packs(batches, "text"):
            x, n = distinct_shingles(buf, offsets, width)
            has, at = n > 0, (np.cumsum(n) - n)[n > 0]
            low = np.zeros((2 * m * r, len(n)), U)
            f1, f2 = fingerprints(x, n)
            if len(x):
                for j in range(2 * m * r):
                    low[j, has] = np.minimum.reduceat(x * factor[j] + shift[j], at)
            low = mixed(low)
            keys = np.zeros((2 * m, len(n)), U)
            for j in range(2 * m * r):
                keys[j // r] = mixed(keys[j // r] + low[j])
            nibbles = np.zeros((-(-2 * m * r // 16), len(n)), U)
            for j in range(2 * m * r):
                nibbles[j // 16] |= (low[j] >> U(60)) << U(4 * (j % 16))
            flat = lambda a: lists(np.ascontiguousarray(a.T).reshape(-1).view(np.int64), np.full(len(n), len(a)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), flat(keys[:m]), flat(keys[m:]), flat(nibbles)], ["id", "n_shingles", "f1", "f2", "left", "right", "bits"])

    return sign


def _sets(width: int):
    def whole(batches):
        for rows, buf, offsets in packs(batches, "text"):
            x, n = distinct_shingles(buf, offsets, width)
            f1, f2 = fingerprints(x, n)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists(x.view(np.int64), n, pa.int64())], ["id", "n_shingles", "f1", "f2", "shingles"])

    return whole


def _confirm(percent: int):
    """Rows sorted by group and part, the representative first: the members that link with it."""

    def confirm(batches):
        now, head = None, None
        for batch in batches:
            groups, parts, heads, ids, sets = (batch.column(c) for c in ("g", "part", "is_rep", "id", "shingles"))
            at, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(U)
            found = []
            for i, (g, p, h) in enumerate(zip(groups.to_pylist(), parts.to_pylist(), heads.to_pylist(), strict=True)):
                own = values[at[i] : at[i + 1]]
                if h:
                    now, head = (g, p), own.copy()
                    continue
                assert now == (g, p), "a representative must come first"
                both = len(np.intersect1d(own, head, assume_unique=True))
                found.append(100 * both >= percent * (len(own) + len(head) - both))
            kept = pa.array(~np.array(heads.to_numpy(zero_copy_only=False), bool))
            yield pa.RecordBatch.from_arrays([ids.filter(kept), groups.filter(kept), pa.array(found, pa.bool_())], ["a", "b", "linked"])

    return confirm


def _links(pairs: DataFrame, sets: DataFrame, percent: int, share: int = 256) -> DataFrame:
    """The pairs (a, b) that link, by full sets. Each set moves once for each of its pairs; b's goes to every part of its group."""
    sized = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts"))
    members = pairs.join(sized, "b").select(F.col("a").alias("id"), F.col("b").alias("g"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(False).alias("is_rep"))
    heads = sized.select(F.col("b").alias("id"), F.col("b").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_rep"))
    rows = members.union(heads).join(sets, "id").select("g", "part", "is_rep", "id", "shingles")
    dealt = rows.repartition("g", "part").sortWithinPartitions("g", "part", F.desc("is_rep"))
    return dealt.mapInArrow(_confirm(percent), "a long, b long, linked boolean").where("linked").select("a", "b")


def minhash_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, m: int = 10, r: int = 3, agree: float = 0.6, crowd: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (is that one).

    m, r: the tensor's size; a pair of similarity s is a candidate with probability
    (1 - (1 - s^r)^m)^2, 0.9998 at 0.85. agree: between two components of one bucket only, pairs
    with fewer equal 4-bit minhashes than this share are not confirmed; at similarity 0.85 a true
    pair falls below it with probability under 1e-6; agree=0 confirms them all. crowd: rows of a bucket's part.
    """
    source = narrowed(docs, id=id_col, text=text_col).where("id is not null").select(F.col("id").cast("long"), "text")
    signed = keep(source.mapInArrow(_signer(m, r, width), SIGNATURE))
    # one row an id; only ids that repeat are sorted out
    repeated = signed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    single = repeated.isEmpty()
    if not single:
        columns = ["n_shingles", "f1", "f2", "left", "right", "bits"]
        chosen = signed.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*columns)).alias("s")).select("id", "s.*")
        signed = signed.join(repeated, "id", "left_anti").unionByName(chosen)
    # one row a set: equal sets need no comparing
    classes = signed.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("id"), F.first("left").alias("left"), F.first("right").alias("right"), F.first("bits").alias("bits"))
    # only keys that two sets share are worth pairing
    ends = classes.select("id", F.expr("inline(concat(transform(left, x -> struct(0 as side, x as end)), transform(right, x -> struct(1 as side, x as end))))"))
    met_twice = ends.groupBy("side", "end").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("side", "end")
    of_side = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("end")))
    paired = ends.join(met_twice, ["side", "end"]).groupBy("id").agg(of_side(0).alias("l"), of_side(1).alias("r"))
    keyed = paired.select("id", F.explode("l").alias("l"), "r").select("id", "l", F.explode("r").alias("r")).select("id", F.xxhash64("l", "r").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = keep(keyed.join(shared, "key").select("id", "key", "n"))
    weight = live.groupBy("id").agg(F.sum("n").alias("w"))
    reps = live.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("rep"))
    near = live.join(reps, "key").where("id <> rep").groupBy("id", "rep").agg(F.count(F.lit(1)).alias("tables"))
    pairs = keep(near.select(F.col("id").alias("a"), F.col("rep").alias("b"), "tables"))
    held = source.join(weight.select("id"), "id", "left_semi").mapInArrow(_sets(width), "id long, n_shingles long, f1 long, f2 long, shingles array<long>")
    # of rows with one id only the chosen one's set; repeats of it do no harm
    held = held if single else held.join(classes.select("id", "n_shingles", "f1", "f2"), ["id", "n_shingles", "f1", "f2"], "left_semi")
    sets = keep(held.select("id", "shingles"))

    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("tables", -F.col("b"))).alias("b"))
    links = keep(_links(best, sets, percent))
    # the other representatives, unless one hop already leads to them
    hop = links.groupBy("a").agg(F.min("b").alias("c"))
    more = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    more = more.join(hop, "a", "left").join(hop.select(F.col("a").alias("b"), F.col("c").alias("d")), "b", "left").where("coalesce(c, a) <> coalesce(d, b)").select("a", "b")
    links = keep(links.union(_links(keep(more), sets, percent)))
    named = keep(connected_components(links).select("id", F.col("component").alias("c")))
    # then all that share a table, wherever components still differ: met in the buckets of one collection
    placed = live.join(named, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    torn = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    open_ = placed.join(torn, "key", "left_semi").groupBy("id").agg(F.first("c").alias("c"))
    seated = open_.join(classes, "id").select("id", "c", "n_shingles", "bits", "left", F.posexplode("left").alias("j", "l"))
    crowds = seated.groupBy("j", "l").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w")).where("lo < hi")
    crowds = crowds.select("j", "l", F.ceil(F.greatest(F.col("n") / crowd, F.col("w") / 1_000_000)).cast("int").alias("parts"))
    seats = seated.join(crowds, ["j", "l"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    seats = seats.select("j", "l", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "id", "c", "n_shingles", "bits", "left").join(sets, "id")
    found = keep(seats.groupBy("j", "l", "first", "second").applyInArrow(_met(percent, int(2 * m * r * (1 - agree))), "a long, b long"))
    if not found.isEmpty():
        named = connected_components(named.select(F.col("id").alias("a"), F.col("c").alias("b")).union(found)).select("id", F.col("component").alias("c"))
    of_class = named.select("id", F.col("c").alias("component"))
    roots = classes.select("f1", "f2", "n_shingles", "id").join(of_class, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = signed.join(roots, ["f1", "f2", "n_shingles"], "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    discard(sets)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _met(percent: int, apart: int):
    """Links between components of a bucket's two parts: a spanning forest of them, never all pairs."""
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        j, first, second = key[0].as_py(), key[2].as_py(), key[3].as_py()
        group = group.combine_chunks()
        ids, c, n, part = (group.column(x).to_numpy() for x in ("id", "c", "n_shingles", "part"))
        left, bits = (group.column(x).combine_chunks().flatten().to_numpy().view(U).reshape(len(ids), -1) for x in ("left", "bits"))
        held = group.column("shingles").combine_chunks()
        at, values = held.offsets.to_numpy(), held.values.to_numpy().view(U)
        root = {x: x for x in c.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i in range(len(ids)):
            rest = np.arange(i + 1, len(ids)) if first == second else np.flatnonzero((part != part[i]) & (np.arange(len(ids)) > i))
            rest = rest[(c[rest] != c[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            # a pair belongs to the first collection key it shares
            rest = rest[~(left[rest, :j] == left[i, :j]).any(axis=1)]
            x = bits[rest] ^ bits[i]
            x |= x >> U(1)
            x |= x >> U(2)
            differ = ones[(x & U(0x1111111111111111)).view(np.uint8)].reshape(len(rest), -1).sum(axis=1) if len(rest) else np.zeros(0, np.int64)
            rest, differ = rest[differ <= apart], differ[differ <= apart]
            own = values[at[i] : at[i + 1]]
            for k in rest[np.argsort(differ, kind="stable")].tolist():
                x, y = top(int(c[i])), top(int(c[k]))
                if x == y:
                    continue
                other = values[at[k] : at[k + 1]]
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    root[max(x, y)] = min(x, y)
                    out.append((ids[i], ids[k]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return meet


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return minhash_clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
