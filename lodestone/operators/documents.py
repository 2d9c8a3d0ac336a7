"""Document versions, publication, and the layout of scanned pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .upsert import one_a_key


def numbered_versions(versions: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """The incoming texts (document_id, clean_text) that are no version yet, as v{count + 1} with their content_hash.

    order: a column that says when a text arrived; versions are numbered by it and of equal texts the first stays (ties: by the rest of the row). Without it, by content_hash.
    """
    hashed = incoming.withColumn("content_hash", F.sha2(F.col("clean_text").cast("binary"), 256))
    if order:
        first = F.struct(F.col(order), *[F.col(c) for c in sorted(hashed.columns) if c != order and not isinstance(hashed.schema[c].dataType, MapType)])
        hashed = one_a_key(hashed.withColumn("_first", first), ["document_id", "content_hash"], "_first", last=False).drop("_first")
    else:
        hashed = hashed.dropDuplicates(["document_id", "content_hash"])
    fresh = hashed.join(versions.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")
    have = versions.groupBy("document_id").agg(F.count(F.lit(1)).alias("_have"))
    at = F.row_number().over(Window.partitionBy("document_id").orderBy(*([order] if order else []), "content_hash"))
    return fresh.join(have, "document_id", "left").withColumn("version_no", F.concat(F.lit("v"), (F.coalesce("_have", F.lit(0)) + at).cast("string"))).drop("_have")


def published(versions: DataFrame, version_id: str, now: Column, metadata: dict[str, object] | None = None) -> DataFrame:
    """versions after one is published: others of its document that were are archived, metadata replaces what isn't null, published_at is set once."""
    mine = F.col("version_id") == version_id
    document = F.max(F.when(mine, F.col("document_id"))).over(Window.partitionBy("document_id"))
    status = F.when(mine, "published").when(document.isNotNull() & (F.col("publish_status") == "published"), "archived").otherwise(F.col("publish_status"))
    more = {k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in (metadata or {}).items() if v is not None}
    return versions.withColumns({"publish_status": status, "published_at": F.when(mine, F.coalesce("published_at", now)).otherwise(F.col("published_at")), **more})


def ocr_lines(words: DataFrame, page: str = "page") -> DataFrame:
    """Recognised words as lines: text in reading order, the box around them, their mean confidence (negative ones don't count)."""
    sure = F.when(F.col("conf").try_cast("double") >= 0, F.col("conf").try_cast("double"))
    lines = words.where(F.trim("text") != "").groupBy(page, "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.avg(sure), 4).alias("confidence"),
    )
    return lines


def overlap(a: Column, b: Column) -> Column:
    """Share of box a that box b covers; boxes are structs of x0, y0, x1, y1."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, side("x0", "x1") * side("y0", "y1") / area).otherwise(0.0)


PARAGRAPH = r"^(第[一二三四五六七八九十百千万0-9]+[章节条]|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十0-9]+[)）]|[0-9]+[.、])"
PAGE_NUMBER = r"^\s*[-—]?\s*(第\s*)?[0-9]{1,4}(\s*页)?\s*[-—]?\s*$"


def merged_blocks(blocks: DataFrame, key: str, gap: float = 1.8) -> DataFrame:
    """Text blocks of a page in reading order, each merged into the one before it if the gap is at most `gap` of its height and it starts no new paragraph.

    Page numbers go. The box a block is compared with grows as blocks are merged, so each document is a fold over its own blocks.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[~frame["text"].str.match(PAGE_NUMBER)].sort_values(["page", "y0", "x0"])
        out: list[dict] = []
        for b in frame.to_dict("records"):
            last = out[-1] if out else None
            near = last is not None and last["page"] == b["page"] and 0 <= b["y0"] - last["y1"] <= gap * (b["y1"] - b["y0"])
            if near and not re.match(PARAGRAPH, b["text"]):
                ascii_ = last["text"][-1:].isascii() and b["text"][:1].isascii()
                last |= {"text": last["text"] + (" " if ascii_ else "") + b["text"], "x0": min(last["x0"], b["x0"]), "x1": max(last["x1"], b["x1"]), "y1": max(last["y1"], b["y1"])}
            else:
                out.append(b)
        return pd.DataFrame([{key: b[key], "order_index": i, **{c: b[c] for c in ("page", "text", "x0", "y0", "x1", "y1")}} for i, b in enumerate(out)], columns=[key, "order_index", "page", "text", "x0", "y0", "x1", "y1"])

    columns = blocks.select(key, "page", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return columns.groupBy(key).applyInPandas(fold, f"{key} {kind}, order_index int, page int, text string, x0 double, y0 double, x1 double, y1 double")


def markdown(elements: DataFrame, key: str) -> DataFrame:
    """key, markdown: titles with as many # as their level (six at most), elements apart by a blank line."""
    line = F.when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.least("heading_level", F.lit(6))), F.lit(" "), F.col("content"))).otherwise(F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("order_index", line.alias("line"))))
    return elements.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("markdown"))


def table_rows(tables: DataFrame, headers: str = "headers", cells: str = "cells") -> Column:
    """'header=value | ...' of a row's cells that aren't empty."""
    pairs = F.filter(F.arrays_zip(F.col(headers).alias("h"), F.col(cells).alias("c")), lambda p: F.coalesce(F.trim(p["c"]), F.lit("")) != "")
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit("="), p["c"])), " | ")
