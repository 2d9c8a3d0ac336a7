"""Phrases whose words come together more often than their parts would have it.

Level by level, from words to phrases of five words. A phrase of k words is a pair of slots, those of
its first k - 1 words and of its last k - 1 words, both frequent (a phrase can't be frequent
otherwise); a word is a pair of hashes of its language and bytes, 128 bits. At each level

* mappers count hashed pairs into a sketch whose cells grow with the corpus, summed by stretches of
  cells; a pair of `least` occurrences is in a cell of as many, so only pairs of such cells are
  candidates (none is missed);
* distinct candidates get a minimal perfect hash with stored keys, at most `group_keys` at a time,
  and it is broadcast, so its size is bounded; more candidates take more passes;
* mappers look up each pair, bincount slots into a numpy array, and the arrays are summed in a tree;
  the last summing reads the keys by slot and lets go of pairs under `least`;
* every text becomes the sequence of its frequent slots, the input of the next level.

All numbers that cuts need are those of frequent phrases, so they are read through the slots of
prefixes and suffixes. Sketch size and passes change the work, never the result.

Defined cases: a null text is empty, a null language 'und'; a language with no frequent phrase gives
no rows; phrases of one score and count are ordered by bytes; repeated rows count each; an empty
table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import LOWER, OTHER, U, flat, gram, lists, mixed, packs, sums, words
from .slot_map import VECTORS, SlotMap, pair_hash, tree_summed, vectors
from .tables import discard, keep, load, narrowed

CELLS = 1 << 30  # of a row of the sketch, at most
SKETCH_ROWS = 2
SEGMENT = 1 << 18  # cells that are summed together
WAITING = 1 << 21  # cells that a task gathers before it counts them
HELD = 1 << 22  # different cells that a task counts before it gives out their counts
WORD_BYTES = 6
GROUP_KEYS = 1 << 22
FANS = 64
PAIR_PARTS = 64
BREAK = np.zeros(256, bool)
BREAK[[ord(x) for x in ".,;:!?"]] = True
BREAK[10:14] = True
OUTSIDE = BREAK.copy()
OUTSIDE[[9, 32]] = True


@dataclass
class Keys:
    """Pairs of some rows: for each row a stretch of positions, the last of which holds no pair."""

    a: np.ndarray
    b: np.ndarray
    at: np.ndarray  # positions that hold a pair
    ends: np.ndarray  # where each row's positions end
    text: Callable[[np.ndarray], list[tuple[str, str]]] | None = None  # language and word of pairs by number


def _language_hash(lang: str) -> tuple[int, int]:
    d = hashlib.blake2b(lang.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray, langs: list[str], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word low[start:end] and its language langs[of]."""
    by_lang = {lang: _language_hash(lang) for lang in set(langs)}
    turn = np.array([by_lang[lang] for lang in langs], U).reshape(-1, 2)[of]
    return mixed(gram(sums(low), start, end) ^ turn[:, 0]), mixed(gram(sums(low, OTHER), start, end) ^ turn[:, 1])


def word_keys(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Keys]]:
    """Of rows (lang, text): the pairs are words, and pieces are parted by a position without one."""
    for rows, held, ends in packs(iter([batch]), "text"):
        low = LOWER[held]
        start, end, per_row = words(low, ends, OUTSIDE)
        row = np.repeat(np.arange(len(rows)), per_row)
        langs = rows.column("lang").to_pylist()
        a, b = _word_hashes(low, start, end, langs, row)
        cut = np.zeros(len(start), np.int64)  # a break before the word
        marks = np.zeros(len(low) + 1, np.int64)
        np.cumsum(BREAK[low], out=marks[1:])
        cut[1:] = (marks[start[1:]] > marks[end[:-1]]) & (row[1:] == row[:-1])
        at = np.arange(len(start)) + np.cumsum(cut) + row  # each row before ends in a position of its own
        spare = np.bincount(row, cut, len(rows)).astype(np.int64)
        yield rows, Keys(a, b, at, np.cumsum(per_row + spare + 1), lambda some: [(langs[row[i]], low[start[i] : end[i]].tobytes().decode()) for i in some])


def slot_keys(batch: pa.RecordBatch, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, Keys]]:
    """Of rows (slots): the pairs are neighbours that both are slots. Rows end in -1 or are empty."""
    column = batch.column("slots")
    held = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        v = held[ends[first] : ends[last]]
        at = np.flatnonzero((v[:-1] >= 0) & (v[1:] >= 0))
        yield batch.slice(first, last - first), Keys(v[at].astype(np.uint64), v[at + 1].astype(np.uint64), at, ends[first + 1 : last + 1] - ends[first])
        first = last


Source = Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, Keys]]]


def _cells(keys: Keys, cells: int) -> list[np.ndarray]:
    """A cell of each pair in each row of the sketch."""
    return [(pair_hash(keys.a, keys.b, (1 << 20) + row) & U(cells - 1)).astype(np.int64) + row * cells for row in range(SKETCH_ROWS)]


def sketch_cells(n: int, least: int, most: int = CELLS) -> int:
    """Cells for n pairs in all: a cell gets `least` / 4 of them on average, at most, however many there are (up to `most` cells)."""
    return min(most, 1 << max(14, (4 * n // least).bit_length()))


def told(x: np.ndarray) -> bytes:
    """Numbers from 0 up in the fewest bytes that hold each, after that width."""
    width = np.min_scalar_type(x.max(initial=0)).itemsize
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def heard(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[0]}", offset=1)


def gaps(x: np.ndarray) -> np.ndarray:
    """What lies between ascending numbers, from 0 on; `np.cumsum` turns it back."""
    return np.diff(x, prepend=x.dtype.type(0))


def cell_counts(source: Source, least: int, cells: int):
    """(segment, gaps between cells, their counts up to `least`) of a task's pairs; each cell of a task once, as far as HELD cells."""
    kind = np.min_scalar_type(least).type

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        n = 0
        at, counts = np.zeros(0, np.uint32), np.zeros(0, kind)

        def merge() -> None:
            nonlocal at, counts, waiting, n
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            both = np.concatenate([at, new])
            order = np.argsort(both, kind="stable")
            both = both[order]
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            times = np.concatenate([counts, np.minimum(times, least).astype(kind)])[order]
            at, counts = both[first], np.minimum(np.add.reduceat(times, first, dtype=np.int64), least).astype(kind)
            waiting, n = [], 0

        def out() -> pa.RecordBatch:
            segment = at // SEGMENT
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            places, times = (np.split(x, starts[1:]) for x in (at % SEGMENT, counts))
            return pa.RecordBatch.from_arrays([pa.array(segment[starts].astype(np.int64)), pa.array([told(gaps(x)) for x in places], pa.binary()), pa.array([x.tobytes() for x in times], pa.binary())], ["segment", "cells", "counts"])

        for batch in batches:
            for _, keys in source(batch):
                if len(keys.a):
                    waiting += [cell.astype(np.uint32) for cell in _cells(keys, cells)]
                    n += SKETCH_ROWS * len(keys.a)
                if n > WAITING:
                    merge()
                    if len(at) > HELD:
                        yield out()
                        at, counts = at[:0], counts[:0]
        if n:
            merge()
        if len(at):
            yield out()

    return count


def hot_cells(df: DataFrame, source: Source, least: int, cells: int) -> np.ndarray:
    """One bit a cell: whether pairs of the cell come `least` times together."""
    kind = np.min_scalar_type(least).type

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, kind)
        found = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["segment", "hot"])
        for batch in batches:
            for segment, at, counts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if segment != now:
                    if (total >= least).any():
                        yield found()
                    now, total = segment, np.zeros(SEGMENT, kind)
                at = np.cumsum(heard(at), dtype=np.int64)
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(counts, kind), least)
        if (total >= least).any():
            yield found()

    out = np.zeros(SKETCH_ROWS * cells // 8, np.uint8)
    parts = df.mapInArrow(cell_counts(source, least, cells), "segment long, cells binary, counts binary").repartition("segment").sortWithinPartitions("segment")
    # bounded: a bit for each cell
    for batch in parts.mapInArrow(add, "segment long, hot binary").toArrow().to_batches():
        for segment, hot in zip(batch.column("segment").to_pylist(), batch.column("hot").to_pylist(), strict=True):
            low = segment * SEGMENT // 8
            out[low : low + SEGMENT // 8] = np.frombuffer(hot, np.uint8)[: len(out) - low]
    return out


def _is_hot(keys: Keys, hot: np.ndarray) -> np.ndarray:
    """Numbers of the pairs whose cells are all hot."""
    bits = [hot[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 for cell in _cells(keys, 8 * len(hot) // SKETCH_ROWS)]
    return np.flatnonzero(np.minimum.reduce(bits))


class Seen:
    """The pairs that a task has given out, as far as `most` of them."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most = most
        self.h = self.a = self.b = np.zeros(0, np.uint64)

    def new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of pairs not seen before, each once; pairs of one hash may come again."""
        h = pair_hash(a, b)
        order = np.argsort(h, kind="stable")
        h, a, b = h[order], a[order], b[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(h) else np.zeros(0, bool)
        if len(self.h) and len(h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            first &= (self.h[at] != h) | (self.a[at] != a) | (self.b[at] != b)
        if len(self.h) > self.most:
            self.h = self.a = self.b = np.zeros(0, np.uint64)
        place = np.searchsorted(self.h, h[first])
        self.h, self.a, self.b = (np.insert(old, place, more[first]) for old, more in ((self.h, h), (self.a, a), (self.b, b)))
        return order[first]


def _texts(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Lists of strings: counts[i] of the values for row i."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, pa.string()))


def candidates(df: DataFrame, source: Source, hot, named: bool) -> DataFrame:
    """Distinct pairs (a, b) of hot cells; named: with lang and word.

    Pairs travel as arrays of few bytes, words as they are written, dealt by hash, and are made distinct again where they meet.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        waiting: list[tuple] = []
        n = 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            part = (pair_hash(a, b, 1 << 21) % U(PAIR_PARTS)).astype(np.int64)
            order = np.argsort(part, kind="stable") if named else np.lexsort((b, a, part))
            held = np.bincount(part, minlength=PAIR_PARTS)
            used = np.flatnonzero(held)
            if named:
                # hashes are made anew where words meet
                texts = np.array([t for w in waiting for t in w[2]], object).reshape(-1, 2)[order]
                return pa.RecordBatch.from_arrays([pa.array(used), *[_texts(texts[:, i], held[used]) for i in (0, 1)]], ["part", "langs", "words"])
            firsts, seconds = (np.split(x[order], np.cumsum(held[used])[:-1]) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array([told(gaps(x)) for x in firsts], pa.binary()), pa.array([told(x) for x in seconds], pa.binary())], ["part", "a", "b"])

        for batch in batches:
            for _, keys in source(batch):
                some = _is_hot(keys, hot.value)
                new = some[seen.new(keys.a[some], keys.b[some])]
                waiting.append((keys.a[new], keys.b[new], keys.text(new) if named else []))
                n += len(new)
                if n > 1 << 18:
                    yield out()
                    waiting, n = [], 0
        if n:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for row in range(len(batch)):
                if named:
                    langs, texts = (batch.column(c)[row].values for c in ("langs", "words"))
                    held, ends = flat(texts)
                    held, ends = held[ends[0] : ends[-1]], ends - ends[0]
                    a, b = _word_hashes(held, ends[:-1], ends[1:], langs.to_pylist(), np.arange(len(texts)))
                else:
                    a, b = np.cumsum(heard(batch.column("a")[row].as_py()), dtype=U), heard(batch.column("b")[row].as_py()).astype(U)
                new = seen.new(a, b)
                columns = [pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64))]
                if named:
                    columns += [x.take(pa.array(new)) for x in (langs, texts)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "lang", "word"][: len(columns)])

    sent, made = ("langs array<string>, words array<string>", ", lang string, word string") if named else ("a binary, b binary", "")
    found = df.mapInArrow(find, f"part long, {sent}").repartition("part").mapInArrow(merge, f"a long, b long{made}")
    return found.groupBy("a", "b").agg(F.min("lang").alias("lang"), F.min("word").alias("word")) if named else found.distinct()


def counted(df: DataFrame, source: Source, slot_map, hot, least: int, first_slot: int) -> DataFrame:
    """(slot, a, b, n) of the map's pairs that come `least` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(slot_map.value), np.int64)
        for batch in batches:
            for _, keys in source(batch):
                some = _is_hot(keys, hot.value)
                slots = slot_map.value.slots(keys.a[some], keys.b[some])
                slots = slots[slots >= 0]
                if 16 * len(slots) > len(total):
                    total += np.bincount(slots, minlength=len(total))
                else:
                    np.add.at(total, slots, 1)
        yield from vectors(total, np.int64, TaskContext.get().partitionId() % FANS)

    def read(slots: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        slots, counts = slots[counts >= least], counts[counts >= least]
        a, b = slot_map.value.a[slots].view(np.int64), slot_map.value.b[slots].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(first_slot + slots), pa.array(a), pa.array(b), pa.array(counts)], ["slot", "a", "b", "n"])

    return tree_summed(df.mapInArrow(count, VECTORS), np.int64, read, "slot long, a long, b long, n long")


def encoded(df: DataFrame, source: Source, slot_map, frequent, first_slot: int, last: bool, columns: list[str]) -> DataFrame:
    """Rows with `next`: at each position the slot of its frequent pair or -1; what passes of other groups wrote stays. last: as `slots`, runs of -1 made one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, keys in source(batch):
                out = np.full(keys.ends[-1], -1, np.int64)
                if "next" in rows.schema.names:
                    out[:] = rows.column("next").flatten().to_numpy(zero_copy_only=False)
                slots = slot_map.value.slots(keys.a, keys.b)
                own = np.flatnonzero(slots >= 0)
                own = own[frequent.value[slots[own]]]
                out[keys.at[own]] = first_slot + slots[own]
                ends = keys.ends
                if last:
                    kept = out >= 0
                    kept[1:] |= out[:-1] >= 0
                    ends, out = np.r_[0, np.cumsum(kept)][ends], out[kept]
                made = {"slots" if last else "next": lists(out, np.diff(ends, prepend=0), pa.int64())}
                if "words" in columns and "words" not in rows.schema.names:
                    made["words"] = pa.array(np.diff(np.searchsorted(keys.at, keys.ends), prepend=0), pa.int64())
                yield pa.RecordBatch.from_arrays([made[c] if c in made else rows.column(c) for c in columns], columns)

    kinds = {"lang": "string", "text": "string", "words": "long", "slots": "array<long>", "next": "array<long>"}
    return df.mapInArrow(write, ", ".join(f"{c} {kinds[c]}" for c in columns))


def next_level(df: DataFrame, source: Source, least: int, cells: int, group_keys: int, final: bool, discarded: bool) -> tuple[DataFrame, DataFrame | None]:
    """The frequent pairs (slot, a, b, n and, of words, lang and word), and the rows as sequences of their slots (None if final)."""
    sc, named = df.sparkSession.sparkContext, source is word_keys
    hot = sc.broadcast(hot_cells(df, source, least, cells))
    found = keep(candidates(df, source, hot, named))
    groups = max(1, -(-found.count() // group_keys))
    dealt = found.withColumn("g", F.pmod(F.xxhash64("a", "b"), F.lit(groups)))
    first, frequent, of = 0, None, ["lang", "words"] if named else []
    for g in range(groups):
        last = g == groups - 1
        # about `group_keys` pairs
        held = dealt.where(F.col("g") == g).select("a", "b").toArrow()
        pairs = [np.concatenate([x.to_numpy() for x in held.column(c).chunks] or [np.zeros(0, np.int64)]).view(np.uint64) for c in ("a", "b")]
        slot_map = sc.broadcast(SlotMap(*pairs))
        found_here = keep(counted(df, source, slot_map, hot, least, first))
        frequent = found_here if frequent is None else frequent.union(found_here)
        if not final:
            is_frequent = np.zeros(len(pairs[0]), bool)
            is_frequent[found_here.select(F.col("slot") - first).toArrow().column(0).to_numpy()] = True
            marks = sc.broadcast(is_frequent)
            carried = of + ([] if last else ["text" if named else "slots"]) + ["slots" if last else "next"]
            before, df = df, keep(encoded(df, source, slot_map, marks, first, last, carried))
            if discarded or g:
                discard(before)
            marks.destroy()
        elif last and discarded:
            discard(df)
        first += len(pairs[0])
        slot_map.destroy()
    hot.destroy()
    if named:
        frequent = keep(frequent.join(found, ["a", "b"]))
    discard(found)
    return frequent, None if final else df


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", cells: int = CELLS, group_keys: int = GROUP_KEYS) -> tuple[list[DataFrame], DataFrame]:
    """For each length a table (slot, a, b, lang, phrase, last, n, lefts, rights) of frequent phrases, and the words of each lang.

    a, b: slots of the first and the last k - 1 words, in the table before. lefts, rights: the
    counts of the first and second parts of every cut.
    """
    rows = narrowed(docs, text=text_col, lang=lang_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<long>")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found, rows = next_level(rows, word_keys, least, sketch_cells(size // WORD_BYTES, least, cells), group_keys, False, False)
    totals = keep(rows.groupBy("lang").agg(F.sum("words").alias("total")))
    levels = [found.select("slot", "a", "b", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("lefts"), none.alias("rights"))]
    cells = sketch_cells(totals.agg(F.sum("total")).first()[0] or 0, least, cells)
    for k in range(2, longest + 1):
        found, rows = next_level(rows.select("slots").where(F.size("slots") > 2) if k == 2 else rows, slot_keys, least, cells, group_keys, k == longest, k > 2)
        of = lambda side: levels[-1].select(*[F.col(c).alias(side + c) for c in ("slot", "lang", "phrase", "last", "n", "lefts", "rights")])  # noqa: E731, B023
        joined = found.join(of("p_"), F.col("a") == F.col("p_slot")).join(of("s_"), F.col("b") == F.col("s_slot"))
        level = joined.select(
            "slot", "a", "b", F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "s_last").alias("phrase"), F.col("s_last").alias("last"), "n",
            F.concat("p_lefts", F.array("p_n")).alias("lefts"), F.concat(F.array("s_n"), F.col("s_rights")).alias("rights"),
        )
        levels.append(keep(level))
    return levels, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` by score, of phrases that no longer one of the same count holds. how: see `phrases`."""
    levels, totals = phrases(docs, least, longest, **how)
    open_ones = []
    for k, level in enumerate(levels[1:], 1):
        if k + 1 < len(levels):
            # a phrase held by a longer one of its count is held by one that is longer by a word
            longer = levels[k + 1].select(F.explode(F.array("a", "b")).alias("slot"), F.col("n").alias("m")).groupBy("slot").agg(F.max("m").alias("m"))
            level = level.join(longer, "slot", "left").where("m is null or m < n").drop("m")
        open_ones.append(level.select("lang", "phrase", F.col("n").alias("a"), "lefts", "rights"))
    all_of = open_ones[0]
    for more in open_ones[1:]:
        all_of = all_of.union(more)
    # 38 digits hold 1000 * a * n and l * r exactly for counts up to 10^17
    cuts = "array_min(transform(lefts, (l, i) -> struct((1000 * cast(a as decimal(17)) * cast(total as decimal(17))) div (cast(l as decimal(17)) * cast(rights[i] as decimal(17))) as score, i as k, l as l, rights[i] as r)))"
    scored = all_of.join(totals, "lang").select("lang", "phrase", "a", F.col("total").alias("n"), F.expr(cuts).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


# every phrase of up to five words written out and counted
ORACLE = r"""
with pieces as (
    select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p
    from documents),
worded as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') w from pieces),
grams as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase from (
        select lang, w, k, unnest(range(1, len(w) - k + 2)) i from (select lang, w, unnest(range(1, 6)) k from worded) where len(w) >= k)),
frequent as (select lang, k, phrase, count(*) f from grams group by all having count(*) >= 100),
totals as (select lang, sum(len(w)) n from worded group by lang),
cuts as (
    select lang, k, phrase, f a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') x, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') y
    from (select *, unnest(range(1, k)) c from frequent where k > 1)),
valued as (
    select cuts.lang, cuts.k, cuts.phrase, a, c, l.f l, r.f r, n, (1000::hugeint * a * n) // (l.f::hugeint * r.f) score
    from cuts join frequent l on l.lang = cuts.lang and l.phrase = x join frequent r on r.lang = cuts.lang and r.phrase = y join totals on totals.lang = cuts.lang),
lowest as (select * from valued qualify row_number() over (partition by lang, phrase order by score, c) = 1),
free as (
    select * from lowest s where not exists (
        select 1 from frequent g where g.lang = s.lang and g.k > s.k and 100 * g.f >= 100 * s.a and contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n::bigint n, score::bigint score
from free qualify rank <= 2000
"""
