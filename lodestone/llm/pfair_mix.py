"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are ordered by a hash of their id and cut into blocks of `block_rows`. Every
slot of the mix takes one block. With weight w, a source's i-th block is released at slot
floor(i / w) and due by ceil((i + 1) / w); of the released blocks the one due first goes next
(earliest deadline first), so after any number of slots t a source has had more than t*w - 1 and
less than t*w + 1 blocks. When a source has no block left, a new phase starts with the weights
of the others. No row is dropped or repeated.

Weights are taken exactly, as the rational numbers they are: nothing is rounded. One task goes
through the slots with a heap of the sources and writes the slot of every block, which rows look
up by a join; neither the driver nor a task holds more than a few values a source.

Defined cases: a null source counts as the source ''; rows that repeat are mixed each for
itself; rows of one id are ordered by a hash of their content; sources with no weight given, or weight 0, share what `rest` says (default: the smallest
weight given); an empty table gives an empty mix; texts are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm
from numbers import Rational

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep

SPREAD = 512  # parts in which a source's rows are ranked


def shares(weights: Mapping[str, Rational | float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def edf_slots(blocks: Mapping[str, int], weights: Mapping[str, Rational | float]) -> Iterator[tuple[str, int]]:
    """(source, block within it) of each slot, until all blocks are placed."""
    done = dict.fromkeys(blocks, 0)
    share = shares({s: weights[s] for s in blocks})
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        whole = sum(share[s] for s in left)
        due = [(-(-whole // share[s]), s, 0) for s in left]
        waiting: list[tuple[int, str, int]] = []  # release, source, block of this phase
        heapq.heapify(due)
        t = 0
        while True:
            while waiting and waiting[0][0] <= t:
                _, s, i = heapq.heappop(waiting)
                heapq.heappush(due, (-(-(i + 1) * whole // share[s]), s, i))
            deadline, s, i = heapq.heappop(due)
            assert deadline > t, "a block missed its deadline"
            if i == left[s]:
                break  # its next block is wanted and it has none: the others go on
            yield s, done[s]
            done[s] += 1
            t += 1
            heapq.heappush(waiting, ((i + 1) * whole // share[s], s, i + 1))


def _scheduled(blocks: Mapping[str, int], weights: Mapping[str, Rational | float]):
    def schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(len(batch) for batch in batches):
            return
        slots, at = edf_slots(blocks, weights), 0
        while part := list(islice(slots, 1 << 16)):
            sources, numbers = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(numbers, pa.int64()), pa.array(range(at, at + len(part)), pa.int64())], ["source", "block", "slot"])
            at += len(part)

    return schedule


MADE = ("mix_source", "mix_block", "mix_slot", "mix_position")


def mix(docs: DataFrame, weights: Mapping[str, Rational | float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 16, rest: float | None = None, spread: int = SPREAD) -> DataFrame:
    """docs with mix_source, mix_block (within the source), mix_slot and mix_position (from 0, of the whole mix; blocks that are not full leave gaps).

    weights: target weight by source; None takes the square roots of the sources' row counts.
    spread: parts in which a source's rows are ranked. Columns of docs under one of the four names give way.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in MADE]
    kept = [F.col(f"`{c}`") for c in names]
    hashed = [F.col(f"`{c}`") for c in names if "map<" not in docs.schema[c].dataType.simpleString()]  # Spark hashes no maps
    # what the caller's columns hold stays in one struct, so no name can clash; rows of one hash (null ids, repeated rows) are dealt out by their whole content
    whole = F.struct(*kept)
    tagged = docs.select(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"), F.xxhash64(F.lit(17), F.col(f"`{id_col}`")).alias("hash"), F.xxhash64(*hashed).alias("tie"), whole.alias("row"))
    tagged = tagged.withColumn("part", F.pmod(F.when(F.col("row").getField(id_col).isNull(), F.col("tie")).otherwise(F.col("hash")), F.lit(spread)).cast("int"))
    # at most `spread` rows a source
    parts = tagged.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if weights is None:
        target = {s: n**0.5 for s, n in counts.items()}
    else:
        low = rest if rest is not None else min((w for w in weights.values() if w > 0), default=1.0)
        target = {s: weights[s] if weights.get(s, 0) > 0 else low for s in counts}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    # a row for each block; the order of slots is one sequence, so one task makes it
    schedule = keep(spark.range(0, 1, 1, 1).mapInArrow(_scheduled(blocks, target), "source string, block long, slot long"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "part").orderBy("hash", "tie")
    ranked = tagged.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["source", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("start")).withColumn("block", F.floor(F.col("rank") / block_rows))
    placed = ranked.join(schedule, ["source", "block"])
    made = (F.col("source"), F.col("block"), F.col("slot"), F.col("slot") * block_rows + F.pmod("rank", F.lit(block_rows)))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in names], *[x.alias(name) for x, name in zip(made, MADE, strict=True)])


def op1_pfair_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")
