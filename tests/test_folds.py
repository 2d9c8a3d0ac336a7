import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.sources import pages

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packing_shuffles_nothing_and_equals_the_grouped_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.split("text", "\n").alias("units"))
    packed = chunking.pack_texts(docs, "doc_id", "units")
    assert "Exchange" not in plan(packed)
    lines = docs.select("doc_id", F.posexplode("units").alias("i", "line")).repartition(5, F.rand(1))
    grouped = chunking.pack_paragraphs(lines, "doc_id", "i", "line")
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, grouped.collect()))


def test_packing_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", None), ("b", []), ("c", [None, "  ", "x"]), (None, ["y"]), ("d", ["z" * 900]), ("e", ["v" * 300, "w"]), ("e", ["again"])], "k string, units array<string>")
    got = {(r.k, r.order_index, r.strategy, len(r.chunk_text)) for r in chunking.pack_texts(rows, "k", "units").collect()}
    assert got == {("c", 0, "paragraph", 1), (None, 0, "paragraph", 1), ("d", 0, "sliding_window", 800), ("d", 1, "sliding_window", 196), ("e", 0, "paragraph", 300), ("e", 1, "paragraph", 1), ("e", 0, "paragraph", 5)}
    assert chunking.pack_texts(rows.limit(0), "k", "units").count() == 0
    with pytest.raises(ValueError):
        chunking.pack_texts(rows, "k", "units", 900, 800)


def test_paths_in_the_pass_over_the_page_equal_the_windows(spark):
    held = spark.read.parquet(f"{SF}/pages.parquet")
    one = pages.page_elements(held, fallback="url", paths=True)
    assert "Exchange" not in plan(one)
    names = ["page_id", "order_index", "content", "heading_path"]
    windows = chunking.heading_paths(pages.page_elements(held, fallback="url"), "page_id", "order_index", "heading_level", "content")
    got = sorted(map(tuple, one.select(*names).collect()))
    assert got == sorted(map(tuple, windows.select(*names).collect())) and len({g[3] for g in got}) > 1


def test_running_paths():
    said = [(None, "p"), (2, "b"), (3, "c"), (None, "p"), (3, "d"), (1, "a"), (4, "e"), (2, "f"), (None, "p")]
    assert pages.running_paths(said) == ["", "b", "b / c", "b / c", "b / d", "a", "a / e", "a / f", "a / f"] and pages.running_paths([]) == []


def test_packing_makes_no_frame_for_each_document(spark):
    rows = spark.createDataFrame([(i, ["ab " * 50, None, " ", "c" * 299, "d" * 2000]) for i in range(1200)] + [(1200, None), (1201, [])], "k long, units array<string>")
    packed = chunking.pack_texts(rows, "k", "units")
    assert "MapInArrow" in packed._jdf.queryExecution().toString()
    found = packed.groupBy("k").count().collect()
    assert len(found) == 1200 and {r["count"] for r in found} == {4}
