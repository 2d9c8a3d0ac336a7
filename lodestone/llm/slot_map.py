"""A minimal perfect hash over pairs of 64-bit words, and numpy counts by slot summed up in a tree.

The hash is a cascade of bit vectors: at each level a key's position is hashed anew; a key that is
alone at its position sets the bit and stays, the others go on. A key's slot is the rank of its
bit, so n keys have the slots 0 to n - 1 and the hash itself takes about four bits a key. A key
that was not put in can land anywhere, so the keys are stored by slot and compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import U, mixed

BLOCK = 1024  # slots of one vector
ODD = U(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def pair_hash(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of both words."""
    return mixed(mixed(a + U((2 * seed + 1) * int(ODD) & MASK)) ^ (b * ODD + U(seed)))


class SlotMap:
    """Slots of distinct pairs (a[i], b[i]); `a` and `b` are kept by slot."""

    def __init__(self, a: np.ndarray, b: np.ndarray, room: float = 2.0) -> None:
        self.sizes: list[int] = []
        words, left = [], np.arange(len(a))
        while len(left):
            size = max(64, int(room * len(left)) + 63 & ~63)
            at = pair_hash(a[left], b[left], len(self.sizes)) % U(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.sizes.append(size)
            left = left[~alone[at]]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.ranks = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        slot = self._landed(a, b)
        self.a[slot], self.b[slot] = a, b

    def __len__(self) -> int:
        return len(self.a)

    def _landed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots in which keys land, their own or not; -1 for keys that land in none."""
        out, left, start = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (pair_hash(a[left], b[left], level) % U(size)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & U(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((U(1) << bit[hit]) - U(1)))
            out[left[hit]] = self.ranks[at[hit] >> 6] + below
            left, start = left[~hit], start + size
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 for those that aren't in the map."""
        out = self._landed(a, b)
        found = np.flatnonzero(out >= 0)
        own = (self.a[out[found]] == a[found]) & (self.b[out[found]] == b[found])
        out[found[~own]] = -1
        return out


VECTORS = "block long, fan long, vector binary"


def vectors(counts: np.ndarray, kind: type, fan: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The blocks of `counts` that aren't all zero, as numbers of the kind."""
    held = np.zeros(-(-len(counts) // BLOCK) * BLOCK, kind)
    held[: len(counts)] = counts
    held = held.reshape(-1, BLOCK)
    used = np.flatnonzero(held.any(axis=1))
    for i in range(0, len(used), rows):
        some = used[i : i + rows]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), fan), pa.int64()), pa.array([row.tobytes() for row in held[some]], pa.binary())], ["block", "fan", "vector"])


def _runs(batches: Iterator[pa.RecordBatch], kind: type, most: int | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block, fan, sum) of consecutive vectors of one block and fan. most: sums stop there."""
    key, total = None, None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        matrix = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(len(batch), BLOCK)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sums = np.add.reduceat(matrix, starts, axis=0, dtype=np.int64)
        for new, vector in zip(keys[starts].tolist(), sums, strict=True):
            if new == key:
                total = total + vector
                continue
            if key is not None:
                yield key[0], key[1], total if most is None else np.minimum(total, most)
            key, total = new, vector
    if key is not None:
        yield key[0], key[1], total if most is None else np.minimum(total, most)


def tree_summed(parts: DataFrame, kind: type, read: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str, most: int | None = None) -> DataFrame:
    """What `read` makes of (slots, counts), counts not 0, once the tasks' vectors are added up: those of one fan first, then the fans'."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(batches, kind, most)
        while some := list(islice(runs, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2].astype(kind).tobytes() for r in some], pa.binary())], ["block", "fan", "vector"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(batches, kind, most)
        while some := list(islice(runs, 1024)):
            sums = np.concatenate([r[2] for r in some])
            at = np.flatnonzero(sums)
            yield read(np.array([r[0] for r in some])[at // BLOCK] * BLOCK + at % BLOCK, sums[at])

    fans = parts.repartition("block", "fan").sortWithinPartitions("block", "fan").mapInArrow(inner, VECTORS)
    fans = fans.selectExpr("block", "0L as fan", "vector")
    return fans.repartition("block").sortWithinPartitions("block").mapInArrow(last, schema)
