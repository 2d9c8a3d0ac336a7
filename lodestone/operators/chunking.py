"""Documents as chunks: windows, sections, packed paragraphs, and their links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, trimmed

ROWS = 512  # documents that a task packs at a time


def check_options(strategy: str, low: int, high: int, overlap: float) -> None:
    if strategy not in ("section", "paragraph", "sliding_window"):
        raise ValueError(f"unknown strategy {strategy}")
    if not 0 < low <= high:
        raise ValueError("0 < min <= max must hold")
    if not 0.10 <= overlap <= 0.15:
        raise ValueError("overlap must be from 0.10 to 0.15")


def sliding_window(rows: DataFrame, key: str, text: str, high: int = 800, overlap: float = 0.12) -> DataFrame:
    """key, order_index, chunk_text: windows of `high` characters that overlap, trimmed, empty ones dropped."""
    step = high - max(1, int(high * overlap))
    size = F.length(text)
    last = F.greatest(F.ceil((size - high) / step), F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: trimmed(F.substr(F.col(text), i * step + 1, F.lit(high))))
    kept = F.filter(windows, lambda w: w != "")
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(kept).alias("order_index", "chunk_text"))


def sections(elements: DataFrame, key: str, order: str, is_title: str) -> DataFrame:
    """elements with `section`: a new one starts at every title."""
    return elements.withColumn("section", F.sum(F.col(is_title).cast("int")).over(Window.partitionBy(key).orderBy(order)).cast("int"))


def heading_paths(elements: DataFrame, key: str, order: str, level: str, content: str, depth: int = 6) -> DataFrame:
    """elements with heading_path 'a / b / c'. A title ends the deeper titles before it, and its path ends with itself."""
    w = Window.partitionBy(key).orderBy(order)
    out, live = elements, []
    for n in range(1, depth + 1):
        # the last heading of this level, unless a higher one came after it
        mine = F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(content).alias("name"))), ignorenulls=True).over(w)
        above = F.max(F.when(F.col(level) < n, F.col(order))).over(w)
        out = out.withColumn(f"_h{n}", mine).withColumn(f"_a{n}", above)
        live.append(F.when(F.col(f"_a{n}").isNull() | (F.col(f"_h{n}.at") > F.col(f"_a{n}")), F.col(f"_h{n}.name")))
    out = out.withColumn("heading_path", F.concat_ws(" / ", *live))
    return out.drop(*[f"_{x}{n}" for x in "ha" for n in range(1, depth + 1)])


def _pack(units: list[str], low: int, high: int, overlap: float) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    buffer: list[str] = []
    size = -2  # of the buffer, joined

    def flush() -> None:
        nonlocal size
        if buffer:
            out.append(("paragraph", "\n\n".join(buffer)))
            buffer.clear()
            size = -2

    step = high - max(1, int(high * overlap))
    for unit in units:
        if len(unit) > high:
            flush()
            starts = range(0, max(1, len(unit) - high + step), step)
            out += [("sliding_window", piece) for s in starts if (piece := unit[s : s + high].strip())]
            continue
        if size + 2 + len(unit) > high:
            flush()
        buffer.append(unit)
        size += 2 + len(unit)
        if size >= low:
            flush()
    flush()
    return out


def pack_texts(rows: DataFrame, key: str, units: str, low: int = 300, high: int = 800, overlap: float = 0.12) -> DataFrame:
    """key, order_index, strategy, chunk_text of rows that hold all units of a document as an array, in order.

    Units are packed until `low` is reached and never beyond `high`; a longer unit is cut into windows. Each row is folded where it is read: nothing is shuffled.
    Null and blank units are left out; a row without units gives no chunk.
    """
    check_options("paragraph", low, high, overlap)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                packed = [_pack([t for u in held or () if u and (t := u.strip())], low, high, overlap) for held in batch.column("_units").to_pylist()]
                at = [i for i, chunks in enumerate(packed) for _ in chunks]
                told = [pa.array([x for chunks in packed for x in some(chunks)], kind) for some, kind in ((lambda c: range(len(c)), pa.int32()), (lambda c: (s for s, _ in c), pa.string()), (lambda c: (t for _, t in c), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(at, pa.int64())), *told], [key, "order_index", "strategy", "chunk_text"])

    return rows.select(F.col(key).alias("_key"), F.col(units).alias("_units")).mapInArrow(fold, f"{key} {rows.schema[key].dataType.simpleString()}, order_index int, strategy string, chunk_text string")


def pack_paragraphs(units: DataFrame, key: str, order: str, content: str, low: int = 300, high: int = 800, overlap: float = 0.12) -> DataFrame:
    """pack_texts for units that stand in rows of their own: one shuffle brings a document's units together, by `order` (ties: by text). A document's units fit a task."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(content).alias("unit")))), lambda u: u["unit"])
    return pack_texts(units.groupBy(key).agg(held.alias("_held")), key, "_held", low, high, overlap)


def linked(chunks: DataFrame, key: str, strategy: str = "sliding_window") -> DataFrame:
    """chunks with chunk_id (a hash of place and content) and those before and after."""
    w = Window.partitionBy(key).orderBy("order_index")
    hashed = chunks.withColumn("chunk_id", content_hash(F.col(key), F.col("order_index"), F.lit(strategy), F.lit(""), F.col("chunk_text")))
    return hashed.withColumn("prev_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))
