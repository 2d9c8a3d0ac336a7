"""Elements of a page layout from boxes: text blocks and tables become titles, paragraphs and tables in reading order.

A document's boxes meet in one row, and one pass over them does the rest: a sweep down each page
leaves out blocks that lie in tables, wrapped blocks are joined, and headings are found by
numbering and by type size against the median of the document. A document without a heading gets
its name as one, before the first element.

Defined cases: null and blank texts are no blocks; page numbers are none either; without sizes the
body counts as 12; boxes of no area count as area 1; a document without boxes has no elements;
equal places keep texts before tables, then go by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

# Numbering that starts a heading, by level, and a paragraph; page numbers; sizes.
NUMERAL = "[一二三四五六七八九十百千万0-9]+"
HEADINGS = ((re.compile(f"第{NUMERAL}章"), 2), (re.compile(f"第{NUMERAL}节"), 3), (re.compile("[一二三四五六七八九十]+、"), 3))
STARTS = re.compile(rf"第{NUMERAL}[条章节]|[（(][一二三四五六七八九十0-9]+[）)]|[一二三四五六七八九十]+、|\d+[.、]")
PAGE_NUMBER = re.compile(r"[-—_ ]*\d+[-—_ ]*")
TITLE_LENGTH, LARGER, BODY, COVERED, GAP, SCANNED_GAP = 80, 2, 12.0, 0.2, 1.8, 1.6

BOX = "x0 double, y0 double, x1 double, y1 double"
ELEMENTS = f"order_index int, element_type string, content string, page_no int, bbox struct<{BOX.replace(' ', ':').replace(':double,:', ':double,')}>, heading_level int, parent_index int, font_size double, confidence double, merged int, generated boolean"


def outside_tables(blocks: list[dict], tables: list[dict], covered: float = COVERED) -> list[dict]:
    """Blocks of which no table covers more than the share, by a sweep down each page: only tables that reach the block's lines are compared."""
    out, pages = [], {}
    for t in tables:
        pages.setdefault(t["page"], []).append(t)
    for rest in pages.values():
        rest.sort(key=lambda t: -t["y0"])  # the next one last
    open_: dict[int, list[dict]] = {}
    # by lower edge a table enters; by upper edge of what follows it leaves
    for b in sorted(blocks, key=lambda b: (b["page"], b["y0"])):
        rest, reach = pages.get(b["page"], []), open_.setdefault(b["page"], [])
        reach[:] = [t for t in reach if t["y1"] > b["y0"]]
        while rest and rest[-1]["y0"] < b["y1"]:
            reach.append(rest.pop())
        area = max((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), 1.0)
        shared = (max(0.0, min(b["x1"], t["x1"]) - max(b["x0"], t["x0"])) * max(0.0, min(b["y1"], t["y1"]) - max(b["y0"], t["y0"])) for t in reach)
        if not any(s / area > covered for s in shared):
            out.append(b)
    return out


def heading(text: str, size: float | None, body: float, first: bool) -> int | None:
    if first and len(text) <= TITLE_LENGTH:
        return 1
    level = next((level for pattern, level in HEADINGS if pattern.match(text)), None)
    large = size is not None and size >= body + LARGER and len(text) <= TITLE_LENGTH
    return level or (2 if large else None)


def _follows(above: dict, b: dict, gap: float) -> bool:
    """Whether b goes on with the paragraph above it."""
    if above["page"] != b["page"] or STARTS.match(b["text"]):
        return False
    tall = max(1.0, above["y1"] - above["y0"], b["y1"] - b["y0"])
    return 0 <= b["y0"] - above["y1"] <= gap * tall


def _joined(above: dict, b: dict) -> dict:
    apart = " " if above["text"][-1].isascii() and b["text"][0].isascii() else ""
    sure = [x["confidence"] for x in (above, b) if x["confidence"] is not None]
    return above | {
        "text": above["text"] + apart + b["text"], "x0": min(above["x0"], b["x0"]), "y0": min(above["y0"], b["y0"]), "x1": max(above["x1"], b["x1"]), "y1": max(above["y1"], b["y1"]),
        "size": above["size"] or b["size"], "confidence": sum(sure) / len(sure) if sure else None, "merged": above["merged"] + b["merged"],
    }


def _place(b: dict) -> tuple:
    return b["page"], b["y0"], b["x0"], b["kind"] == "table", b["text"]


def elements_of(blocks: list[dict], tables: list[dict], name: str, scanned: bool = False) -> list[dict]:
    """A document's elements. scanned: lines of recognised words, which have no type sizes and narrower gaps; of their elements only the first can be a title by its place."""
    blocks = [b | {"kind": "paragraph", "merged": 1} for b in outside_tables(blocks, tables) if not PAGE_NUMBER.fullmatch(b["text"].strip())]
    sizes = [b["size"] for b in blocks if b["size"] is not None]
    body, gap = median(sizes) if sizes else BODY, SCANNED_GAP if scanned else GAP
    texts, titled = [], False
    for b in sorted(blocks, key=_place):
        alone = heading(b["text"], b["size"], body, not titled) is not None
        if not alone and texts and not texts[-1]["alone"] and _follows(texts[-1], b, gap):
            texts[-1] = _joined(texts[-1], b)
        else:
            texts.append(b | {"alone": alone})
        titled |= alone
    found, above, titled = [], [], False  # above: (level, number) of the headings that hold what follows
    for b in sorted([*texts, *[t | {"kind": "table", "merged": 0, "size": None, "confidence": None} for t in tables]], key=_place):
        first = not found if scanned else not titled and b["kind"] == "paragraph"
        level, parent = heading(b["text"], b["size"], body, first), None
        if level:
            above = [x for x in above if x[0] < level]
            parent = above[-1][1] if above else None
            above.append((level, len(found)))
            titled = True
        found.append({"element_type": "title" if level else b["kind"], "content": b["text"], "page_no": b["page"], "bbox": {c: round(b[c], 2) for c in ("x0", "y0", "x1", "y1")}, "heading_level": level, "parent_index": parent, "font_size": b["size"], "confidence": b["confidence"], "merged": b["merged"], "generated": False})
    if found and not titled:
        made = {"element_type": "title", "content": name, "page_no": 1, "bbox": None, "heading_level": 1, "parent_index": None, "font_size": None, "confidence": None, "merged": 0, "generated": True}
        # parents move by one, should there be any
        found = [made] + [e | {"parent_index": None if e["parent_index"] is None else e["parent_index"] + 1} for e in found]
    return [e | {"order_index": i} for i, e in enumerate(found)]


def layout(blocks: DataFrame, tables: DataFrame, names: DataFrame, key: str, scanned: bool = False) -> DataFrame:
    """key and its elements, a row each.

    blocks: key, page, text, x0, y0, x1, y1 and, where known, size and confidence. tables: key, page,
    text (see `table_text`) and box. names: key, name, what a document without headings is called.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        more = [F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in ("size", "confidence")]
        one = rows.select(key, F.col("page").cast("int").alias("page"), normalize_text("text").alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], *more).where("text <> ''")
        return one.groupBy(key).agg(F.collect_list(F.struct(*[c for c in one.columns if c != key])).alias(name))

    rows = gathered(blocks, "blocks").join(gathered(tables, "tables"), key, "full").join(names.select(key, normalize_text("name").alias("name")), key, "left")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one document at a time
                row = batch.slice(i, 1).to_pylist()[0]
                made = elements_of(row["blocks"] or [], row["tables"] or [], row["name"] or "", scanned)
                if made:
                    yield pa.RecordBatch.from_pylist([{key: row[key]} | e for e in made], schema=schema)

    box = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
    types = {"order_index": pa.int32(), "element_type": pa.string(), "content": pa.string(), "page_no": pa.int32(), "bbox": box, "heading_level": pa.int32(), "parent_index": pa.int32(), "font_size": pa.float64(), "confidence": pa.float64(), "merged": pa.int32(), "generated": pa.bool_()}
    schema = pa.schema([(key, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), *types.items()])
    return rows.select(key, "name", "blocks", "tables").mapInArrow(fold, f"{key} {kind}, {ELEMENTS}")


def table_text(cells):
    """A table's rows (array of arrays of strings) as lines of ' | ', blank cells and rows left out."""
    filled = F.transform(cells, lambda row: F.filter(F.transform(row, lambda c: normalize_text(F.coalesce(c, F.lit("")))), lambda c: c != ""))
    return F.array_join(F.transform(F.filter(filled, lambda row: F.size(row) > 0), lambda row: F.array_join(row, " | ")), "\n")


def titles(elements: DataFrame, key: str) -> DataFrame:
    """key, title, page_count, clean_text: the first title, the pages that hold elements, all contents."""
    ordered = F.array_sort(F.collect_list(F.struct("order_index", "content")))
    first = F.min(F.when(F.col("element_type") == "title", F.struct("order_index", "content")))
    return elements.groupBy(key).agg(first["content"].alias("title"), F.count_distinct("page_no").alias("page_count"), F.array_join(F.transform(ordered, lambda e: e["content"]), "\n").alias("clean_text"))
