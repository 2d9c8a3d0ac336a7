"""Suffix-array style dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

Bucket-pointer refinement, on the suffixes that matter. The initial buckets are q-grams; a
suffix is placed by the q-gram with the smallest hash inside its first `length` bytes (its
anchor), so equal strings meet in one bucket and one suffix in about seventy needs a row. A
bucket with one member is finished. In the others suffixes point at their bucket, from eight
bytes on, and are refined by sorting them on their own bucket and that of the suffix h bytes
later; the pointers just made serve for twice as many bytes, until they stand for `length`. What
stands alone is finished and sorted no more. Runs of neighbouring suffixes that share their
anchor are refined together: when the whole run's stretch repeats (by 128 bits of hash), all its
suffixes do; only runs that end a repeat are refined suffix by suffix, and there bytes decide.

Texts that come more than once go first, by 128 bits of hash: all their bytes go, and one copy of
each stays for the others to be compared with. The other texts stay where they are until the
runs of each are known; they are shuffled twice, by a hash of the text, to refine and to cut. No bucket is gathered in one task: counts are
pre-aggregated, joins are left to skew splitting, and buckets beyond `crowd` members are refined
as rows instead of in batches: blocks of `block` suffixes go into deeper buckets (the bytes that
all of them hold), and only what ends a repeat there becomes rows of suffixes.

Defined cases: null and empty texts have n_bytes 0 and nothing removed; texts shorter than
`length` bytes lose nothing; each input row gives one output row, and rows that repeat (same id
or not) are repeats of each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import OTHER, U, gram, mixed, packs, sums
from .tables import discard, keep

PLACE = 22  # bits of a position in a pack; packs are kept below 2^22 bytes unless one text is longer


def _sliding_least(v: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    m = -(-len(v) // k) * k
    padded = np.full(m, ~U(0))
    padded[: len(v)] = v
    rows = padded.reshape(-1, k)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(v) - k + 1
    return np.minimum(after[:n], before[k - 1 : k - 1 + n])


def anchored_runs(buf: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """(text's number, start, suffixes, q-gram's hash, whole stretch's two hashes) of each run of suffixes with one anchor.

    Ties go to the leftmost q-gram, so the anchor depends on the suffix's own bytes alone.
    """
    n = len(buf)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U), none.view(U), none.view(U)
    bits = max(PLACE, n.bit_length())
    prefix = sums(buf)
    grams = gram(prefix, np.arange(n - q + 1), np.arange(q, n + 1))
    v = (grams >> U(bits) << U(bits)) | np.arange(len(grams), dtype=U)
    anchor = (_sliding_least(v, length - q + 1) & U((1 << bits) - 1)).astype(np.int64)
    start = np.arange(n - length + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    inside = start + length <= offsets[1:][doc]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & inside)
    run = np.cumsum(new & inside) - 1
    many = np.bincount(run[inside], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    whole = [mixed(gram(x, first, first + many + length - 1) + many.astype(U)) for x in (prefix, sums(buf, OTHER))]
    return doc[first], first - offsets[doc[first]], many, grams[anchor[first]], *whole


def _runs(length: int, q: int):
    def runs(batches):
        for rows, buf, offsets in packs(batches, "text", 1 << 20):
            doc, start, many, grams, whole, other = anchored_runs(buf, offsets, length, q)
            keys = rows.column("k").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(grams.view(np.int64)), pa.array((whole | U(1)).view(np.int64)), pa.array(other.view(np.int64))], ["k", "start", "many", "gram", "whole", "other"])

    return runs


def refined(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of all `length`-byte strings in data: equal where the bytes are. length: eight at least."""
    n = len(data) - length + 1
    h = 8
    words_ = np.zeros(len(data) - h + 1, U)
    for i in range(h):
        words_ |= data[i : i + len(words_)].astype(U) << U(8 * i)
    pointer = np.unique(words_, return_inverse=True)[1].astype(np.int64)
    while h < length:
        step = min(h, length - h)
        m = len(pointer) - step
        crowded = np.bincount(pointer)[pointer] > 1
        # what stands alone keeps its pointer; the others are sorted on both pointers
        open_ = np.flatnonzero(crowded[:m])
        new = pointer[:m].copy()
        if len(open_):
            pair = pointer[open_] << 32 | pointer[open_ + step]
            new[open_] = pointer.max() + 1 + np.unique(pair, return_inverse=True)[1]
            new = np.unique(new, return_inverse=True)[1] if new.max() >> 31 else new
        pointer, h = new, h + step
    return pointer[:n]


def _contexts(length: int):
    """Of each text with open runs, the bytes of each: what its suffixes span."""

    def cut(batches):
        for batch in batches:
            for rows, buf, offsets in packs([batch], "text"):
                opened = rows.column("opened")
                at, runs = opened.offsets.to_numpy(), opened.flatten()
                at = at - at[0]
                start, many, grams, crowd = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "many", "gram", "crowd"))
                owner = np.repeat(np.arange(len(rows)), np.diff(at))
                base = offsets[owner] + start
                data = buf.tobytes()
                pieces = [data[a : a + m + length - 1] for a, m in zip(base.tolist(), many.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(crowd), rows.column("k").take(pa.array(owner)), pa.array(start), pa.array(pieces, pa.binary())], ["gram", "crowd", "k", "start", "piece"])

    return cut


def _suffixes(pieces: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in the row's piece) of each suffix, the pieces' bytes and where each suffix stands in them."""
    at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    many = np.diff(at) - length + 1
    row = np.repeat(np.arange(len(pieces)), many)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, offset, data, at[row] + offset


def _intervals(k: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Neighbouring starts of a text as one row, in the given order."""
    if not len(k):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], ["k", "start", "many"])
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(k)))
    return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(start[first].astype(np.int32)), pa.array(many.astype(np.int32))], ["k", "start", "many"])


def _refine_together(length: int):
    """Rows sorted by q-gram: which suffixes repeat. A bucket that a batch cuts waits for its rest."""

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, offset, data, at = _suffixes(batch.column("piece"), length)
        ids = refined(data, length)[at]
        again = np.bincount(ids)[ids] > 1
        k, start = batch.column("k").to_numpy()[row], batch.column("start").to_numpy()[row] + offset
        return _intervals(k[again], start[again])

    def refine(batches):
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            grams = batch.column("gram").to_numpy()
            if not len(grams):
                continue
            cut = int(np.searchsorted(grams, grams[-1]))
            rest = batch.slice(cut)
            for s in range(0, cut, 20_000):
                lo, hi = (int(np.searchsorted(grams[:cut], grams[min(x, cut - 1)])) if 0 < x < cut else min(x, cut) for x in (s, s + 20_000))
                if hi > lo:
                    yield settle(batch.slice(lo, hi - lo))
        if rest is not None and len(rest):
            yield settle(rest)

    return refine


def _refine_apart(length: int):
    def refine(batches):
        for batch in batches:
            for s in range(0, len(batch), 20_000):
                part = batch.slice(s, 20_000)
                row, offset, data, at = _suffixes(part.column("piece"), length)
                ids = [gram(x, at, at + length).view(np.int64) for x in (sums(data), sums(data, OTHER))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, ids), part.column("k").take(pa.array(row)), pa.array((part.column("start").to_numpy()[row] + offset).astype(np.int32))], ["sid", "sid2", "k", "start"])

    return refine


def _blocked(length: int, q: int, block: int):
    """Runs of a crowded bucket, cut at fixed distances from their anchor: the bytes that every suffix of such a block holds (its deeper bucket), its whole stretch, and its bytes."""

    def cut(batches):
        for batch in batches:
            rows: list[tuple] = []
            for gram_, k, start, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "k", "start", "piece")), strict=True):
                data = np.frombuffer(piece, np.uint8)
                many, prefix, second = len(data) - length + 1, sums(data), sums(data, OTHER)
                lo, hi = many - 1, length - q + 1  # the anchor lies inside every suffix
                grams = gram(prefix, np.arange(lo, hi), np.arange(lo + q, hi + q)).view(np.int64) & np.int64(-2)
                anchor = lo + int(np.flatnonzero(grams == gram_)[0])
                far = (anchor - np.arange(many)) // block
                first = np.flatnonzero(np.append(True, far[1:] != far[:-1]))
                size = np.diff(np.append(first, many))
                left = anchor - far[first] * block
                core = mixed(gram(prefix, left, left + length - block + 1) + far[first].astype(U)) & ~U(1)
                whole, other = (mixed(gram(x, first, first + size + length - 1) + size.astype(U)) for x in (prefix, second))
                rows += [(k, start + a, n, c, w, o, piece[a : a + n + length - 1]) for a, n, c, w, o in zip(first.tolist(), size.tolist(), core.view(np.int64).tolist(), (whole | U(1)).view(np.int64).tolist(), other.view(np.int64).tolist(), strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "start", "many", "gram", "whole", "other", "piece"])

    return cut


def _cut(length: int):
    def cut(batches):
        for batch in batches:
            for rows, buf, offsets in packs([batch], "text"):
                n_removed, n_spans, shas = [], [], []
                gone, data = rows.column("gone"), buf.tobytes()
                at, runs = gone.offsets.to_numpy(), gone.flatten()
                at = at - at[0]
                start, many = runs.field("start").to_numpy().astype(np.int64), runs.field("many").to_numpy().astype(np.int64)
                for i in range(len(rows)):
                    text = data[offsets[i] : offsets[i + 1]]
                    a = start[at[i] : at[i + 1]]
                    if not len(a):
                        n_removed.append(0), n_spans.append(0), shas.append(hashlib.sha256(text).hexdigest())
                        continue
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate((a + many[at[i] : at[i + 1]] + length - 1)[order])
                    new = np.append(True, a[1:] > b[:-1])
                    lo, hi = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                    left, pos = hashlib.sha256(), 0
                    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                        left.update(text[pos:x])
                        pos = y
                    left.update(text[pos:])
                    n_removed.append(int((hi - lo).sum())), n_spans.append(len(lo)), shas.append(left.hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut


def repeated_runs(docs: DataFrame, length: int = 200, q: int = 32, crowd: int = 4096, block: int = 16) -> DataFrame:
    """(k, start, many): suffixes [start, start + many) of row k whose first `length` bytes also start elsewhere. docs: k, text."""
    runs = keep(docs.mapInArrow(_runs(length, q), "k long, start int, many int, gram long, whole long, other long"))
    # both kinds of identifier in one count; q-grams are made even and whole stretches odd
    runs = runs.withColumn("gram", F.col("gram").bitwiseAND(F.lit(-2)))
    often = keep(_often(runs))
    alive = runs.join(often.where("other = 0").select(F.col("id").alias("gram"), (F.col("n") > crowd).alias("crowd")), "gram")
    alive = alive.join(often.select(F.col("id").alias("whole"), "other", F.lit(True).alias("done")), ["whole", "other"], "left")
    alive = keep(alive.select("k", "start", "many", "gram", "crowd", "whole", "other", F.coalesce("done", F.lit(False)).alias("done")))
    discard(runs)
    # a finished stretch still matters to the open runs of its bucket: one of each goes along
    fields = ["k", "start", "many", "gram", "crowd"]
    still = alive.where("not done").select(*fields)
    finished = alive.where("done").groupBy("whole", "other").agg(F.min(F.struct(*fields)).alias("one")).select("one.*").join(still.select("gram").distinct(), "gram", "left_semi").select(*fields)
    opened = still.union(finished).groupBy("k").agg(F.collect_list(F.struct("start", "many", "gram", "crowd")).alias("opened"))
    pieces = keep(docs.join(opened, "k").mapInArrow(_contexts(length), "gram long, crowd boolean, k long, start int, piece binary"))
    small = pieces.where("not crowd").drop("crowd").repartition("gram").sortWithinPartitions("gram").mapInArrow(_refine_together(length), "k long, start int, many int")
    # crowded buckets: deeper buckets first, then only blocks that end a repeat as rows of suffixes
    blocks = keep(pieces.where("crowd").drop("crowd").mapInArrow(_blocked(length, q, block), "k long, start int, many int, gram long, whole long, other long, piece binary"))
    often = keep(_often(blocks))
    deep = blocks.join(often.where("other = 0").select(F.col("id").alias("gram")), "gram").join(often.select(F.col("id").alias("whole"), "other", F.lit(True).alias("done")), ["whole", "other"], "left")
    settled = deep.where("done").select("k", "start", "many")
    ends = deep.where("done is null").select("gram", "k", "start", "piece")
    one = deep.where("done").groupBy("whole", "other").agg(F.min(F.struct("gram", "k", "start", "piece")).alias("one")).select("one.*").join(ends.select("gram").distinct(), "gram", "left_semi")
    each = keep(ends.union(one.select("gram", "k", "start", "piece")).select("k", "start", "piece").mapInArrow(_refine_apart(length), "sid long, sid2 long, k long, start int"))
    again = each.groupBy("sid", "sid2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sid", "sid2")
    large = settled.union(each.join(again, ["sid", "sid2"]).select("k", "start", F.lit(1).alias("many")))
    out = keep(alive.where("done").select("k", "start", "many").union(small).union(large))
    discard(alive)
    discard(pieces)
    return out


def _often(runs: DataFrame) -> DataFrame:
    """(id, other, n) of the q-grams (other: 0) and whole stretches that come more than once."""
    both = F.array(F.struct(F.col("gram").alias("id"), F.lit(0).cast("long").alias("other")), F.struct(F.col("whole").alias("id"), "other"))
    return runs.select(F.inline(both)).groupBy("id", "other").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, q: int = 32, crowd: int = 4096, block: int = 16) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    result = lambda rows, removed, spans, kept: rows.select("doc_id", size.alias("n_bytes"), removed.cast("long").alias("n_removed"), F.lit(spans).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))
    short = result(source.where(size < length), F.lit(0), 0, F.col("text"))
    keyed = source.where(size >= length).withColumns({"k": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    classes = keep(keyed.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("n")))
    # different texts with one 64-bit key (hardly ever any) go by the other one
    clash = classes.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", F.lit(True).alias("clash"))
    if clash.isEmpty():
        keyed = keyed.withColumn("key", F.col("k"))
    else:
        keyed = keyed.join(clash, "k", "left").withColumn("key", F.when(F.col("clash"), F.col("k2")).otherwise(F.col("k")))
    repeated = classes.where("n > 1").select("k", "k2")
    whole = result(keyed.join(repeated, ["k", "k2"], "left_semi"), size, 1, F.lit(""))
    once = keyed.join(repeated, ["k", "k2"], "left_anti")
    one = keyed.join(repeated, ["k", "k2"], "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    compared = once.select(F.col("key").alias("k"), "text").union(one)
    gone = repeated_runs(compared, length, q, crowd, block).groupBy("k").agg(F.collect_list(F.struct("start", "many")).alias("gone"))
    empty = F.array().cast("array<struct<start:int,many:int>>")
    rows = once.select(F.col("key").alias("k"), "doc_id", "text").join(gone, "k", "left").select("doc_id", "text", F.coalesce("gone", empty).alias("gone"))
    cut = rows.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.union(whole).union(short)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
