"""Embedding near-dedup by a subspace pigeonhole join.

For unit vectors cosine >= c means squared distance <= 2 - 2c. After a random rotation the
coordinates are split into `blocks` blocks of few dimensions; by the pigeonhole principle a
near pair is within its share, (2 - 2c) / blocks, in one block at least. Each block is range-
joined over a grid that halves its coordinates in turn, the oftener the more vectors there are; every pair found is confirmed by its exact cosine
and counted in the first block that finds it, so the union needs no list of pairs.

Equal vectors fall together first and are counted by multiplicity. A crowded cell is split into
parts that meet two at a time; a task returns counts and a spanning forest of its links, never
the links themselves, so a group of thousands of near copies stays linear in what is shuffled.
Cells carry ids; vectors join them once the crowded cells are known. Inside a task, hosts are
halved into small groups of neighbours, each compared with what its box can reach.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing (n_links 0, a component of their own, kept); vectors of different lengths do not
link; of rows with one id the smallest vector counts; null ids are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import keep
from .vectors import matrix, one_each, rotation, usable

CELLS = "block int, cell long, home boolean, id long"


def _turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; each row's bits depend on that row alone (no blocked product)."""
    u = x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
    return np.einsum("nd,ed->ne", u, rotation(x.shape[1]))


def _spans(d: int, blocks: int) -> list[tuple[int, int]]:
    ends = np.linspace(0, d, min(blocks, d) + 1).astype(int)
    return list(itertools.pairwise(ends.tolist()))


def _celled(budget: float, blocks: int, cuts: dict[int, list[list[list[float]]]]):
    """Each vector in its cell of each block's grid, and as a guest in the earlier cells within reach. cuts: by length, block and coordinate, where the grid cuts."""

    def place(batches):
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == d))
                t = _turned(matrix(rows.column("v")))
                spans = _spans(int(d), blocks)
                share = budget / len(spans) * (1 + 1e-9)
                for b, (lo, _) in enumerate(spans):
                    # coordinate by coordinate: the cells still within reach of each vector, with the squared gap so far
                    at, cell, gap, home = np.arange(len(t)), np.zeros(len(t), np.int64), np.zeros(len(t)), np.zeros(len(t), np.int64)
                    for j, marks in enumerate(cuts[int(d)][b]):
                        y, edges = t[:, lo + j], np.array([-np.inf, *marks, np.inf])
                        home = home * (len(marks) + 1) + np.searchsorted(edges[1:-1], y, "right")
                        reached = []
                        for i in range(len(marks) + 1):
                            z = np.maximum(np.maximum(edges[i] - y[at], y[at] - edges[i + 1]), 0)
                            near = gap + z * z <= share
                            reached.append((at[near], cell[near] * (len(marks) + 1) + i, (gap + z * z)[near]))
                        at, cell, gap = (np.concatenate(x) for x in zip(*reached, strict=True))
                    earlier = cell <= home[at]
                    at, cell = at[earlier], cell[earlier]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(cell * 65536 + d), pa.array(cell == home[at]), rows.column("id").take(pa.array(at))], ["block", "cell", "home", "id"])

    return place


def _grids(classes: DataFrame, blocks: int, cell_rows: int, most: int = 4096) -> dict[int, list[list[list[float]]]]:
    """By length, block and coordinate the cuts of the grid: medians first, then finer quantiles, until a cell has about `cell_rows` vectors.

    Cuts come from at most `most` vectors of each length, those with the smallest hashes; wherever they lie, no link is lost.
    """
    sizes = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for r in sizes:
        d, n = r["d"], r["n"]
        halves = max(3, math.ceil(math.log2(max(1, n / cell_rows))))
        part = min(1.0, 2 * most / n)
        near = classes.where((F.size("v") == d) & (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(part * (1 << 30))))
        t = _turned(matrix(near.select("v", F.xxhash64(F.lit(3), "id").alias("o")).orderBy("o").limit(most).toArrow().column("v").combine_chunks()))
        out[d] = []
        for lo, hi in _spans(d, blocks):
            # a block's coordinates are halved in turn
            times = [halves // (hi - lo) + (j < halves % (hi - lo)) for j in range(hi - lo)]
            out[d].append([sorted(set(np.quantile(t[:, lo + j], np.arange(1, 1 << m) / (1 << m)).tolist())) if len(t) else [] for j, m in enumerate(times)])
    return out


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: each points at its tree's smallest row."""
    while True:
        la, lb = labels[a], labels[b]
        if np.array_equal(la, lb):
            return labels
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while not np.array_equal(labels, nxt := labels[labels]):
            labels = nxt


def _leaves(y: np.ndarray, hosts: np.ndarray, others: np.ndarray, budget: float, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hosts in groups of neighbours, halved along the widest axis down to `size`, each with the others that its box can reach."""
    stack = [(hosts, others)] if len(hosts) else []
    while stack:
        part, rest = stack.pop()
        low, high = y[part].min(axis=0), y[part].max(axis=0)
        z = y[rest]
        gap = np.maximum(low - z, 0)
        gap += np.maximum(z - high, 0)
        rest = rest[np.einsum("nd,nd->n", gap, gap) <= budget]
        if len(part) <= size:
            yield part, rest
            continue
        order = np.argpartition(y[part, int(np.argmax(high - low))], len(part) // 2)
        stack += [(part[order[: len(part) // 2]], rest), (part[order[len(part) // 2 :]], rest)]


def _met(cosine: float, blocks: int, leaf: int = 64):
    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        block, first, second = key[0].as_py(), key[2].as_py(), key[3].as_py()
        group = group.combine_chunks()
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        home, part = group.column("home").to_numpy().astype(bool), group.column("part").to_numpy()
        order = np.lexsort((ids, part, ~home))
        ids, n, home, part = ids[order], n[order], home[order], part[order]
        x = matrix(group.column("v").combine_chunks().take(pa.array(order)))
        t = _turned(x)
        spans = _spans(x.shape[1], blocks)
        starts = np.array([lo for lo, _ in spans])
        lo, hi = spans[block]
        budget = (2 - 2 * cosine) / len(spans) * (1 + 1e-9)
        y, norm = t[:, lo:hi], np.sqrt(np.einsum("nd,nd->n", x, x))
        size = np.einsum("nd,nd->n", y, y)
        labels, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        every = np.arange(len(ids))
        for side in (first, second) if first != second else (first,):
            others = every[part != side] if first != second else every
            for h, near_by in _leaves(y, np.flatnonzero(home & (part == side)), others, budget + 1e-12, leaf):
                near = size[h][:, None] + size[near_by][None, :] - 2 * (y[h] @ y[near_by].T) <= budget + 1e-12
                near &= ~home[near_by][None, :] | (near_by[None, :] > h[:, None])
                i, j = np.nonzero(near)
                for k in range(0, len(i), 100_000):
                    a, b = h[i[k : k + 100_000]], near_by[j[k : k + 100_000]]
                    gap = t[a] - t[b]
                    found = np.add.reduceat(gap * gap, starts, axis=1) <= budget
                    mine = found[:, block] & ~found[:, :block].any(axis=1)
                    a, b = a[mine], b[mine]
                    linked = np.einsum("nd,nd->n", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
                    a, b = a[linked], b[linked]
                    count += np.bincount(a, n[b], len(ids)).astype(np.int64) + np.bincount(b, n[a], len(ids)).astype(np.int64)
                    labels = _forest(labels, a, b)
        out = np.flatnonzero(count > 0)
        return pa.table({"id": ids[out], "links": count[out], "to": ids[labels[out]]})

    return meet


def vector_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, blocks: int = 8, cell_rows: int = 8192, crowd: int = 32768) -> DataFrame:
    """id, n_links, component_id, kept. cell_rows: vectors that a cell should hold; crowd: rows (with guests) of a cell's part."""
    every = one_each(vectors, id_col, vector_col)
    # single precision stays single while it is shuffled; all arithmetic is double
    held = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    sound = every.where(usable("v")).select("id", F.col("v").cast(held).alias("v"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    classes = keep(sound.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")))
    placed = keep(classes.select("id", "v").mapInArrow(_celled(2 - 2 * cosine, blocks, _grids(classes, blocks, cell_rows)), CELLS))
    cells = placed.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("hosted")).where("rows > 1 and hosted").select("block", "cell", F.ceil(F.col("rows") / crowd).cast("int").alias("parts"))
    rows = placed.join(cells, ["block", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("block", "cell", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "home", "id").join(classes.select("id", "n", "v"), "id")
    met = keep(rows.groupBy("block", "cell", "first", "second").applyInArrow(_met(cosine, blocks), "id long, links long, to long"))
    roots = connected_components(met.select(F.col("id").alias("a"), F.col("to").alias("b")))
    linked = met.groupBy("id").agg(F.sum("links").alias("links"))
    groups = classes.select("k1", "k2", "id", "n").join(linked, "id", "left").join(roots, "id", "left")
    groups = groups.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    found = sound.select("id", "k1", "k2").join(groups, ["k1", "k2"]).select("id", "n_links", "component_id")
    out = every.select("id").join(found, "id", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_pigeonhole(spark, sf_dir: str) -> DataFrame:
    return vector_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
