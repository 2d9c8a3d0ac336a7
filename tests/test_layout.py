import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.operators.documents import markdown

SCHEMA = "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double, size double"
TABLE = "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double"
ROOM = (50.0, 500.0)


def run(spark, blocks, tables=(), names=((1, "Fallback"),), **how):
    rows = spark.createDataFrame([(1, p, t, ROOM[0], float(y), ROOM[1], float(y + h), s) for p, t, y, h, s in blocks], SCHEMA)
    out = layout.layout(rows, spark.createDataFrame(list(tables), TABLE), spark.createDataFrame(list(names), "doc long, name string"), "doc", **how)
    return [r.asDict(recursive=True) for r in out.orderBy("doc", "order_index").collect()]


def test_title_paragraphs_and_table(spark):
    cells = spark.sql("select array(array('Metric', 'Value'), array('GDP', null), array('', ' '), array(' Growth ', '5%')) as c").select(layout.table_text("c")).first()[0]
    assert cells == "Metric | Value\nGDP\nGrowth | 5%"
    blocks = [(1, "Public  Data Policy", 72, 20, 18.0), (1, "Article 1 This policy governs public data.", 130, 12, 11.0), (1, "Metric", 202, 12, 11.0), (1, "- 1 -", 800, 10, 9.0), (1, "  ", 810, 10, 9.0)]
    found = run(spark, blocks, [(1, 1, cells, 72.0, 200.0, 372.0, 260.0)])
    assert [(e["element_type"], e["content"], e["heading_level"], e["parent_index"]) for e in found] == [
        ("title", "Public Data Policy", 1, None), ("paragraph", "Article 1 This policy governs public data.", None, None), ("table", cells, None, None)]
    assert found[0]["bbox"] == {"x0": 50.0, "y0": 72.0, "x1": 500.0, "y1": 92.0}
    rows = spark.createDataFrame([(1, e["order_index"], e["content"], e["heading_level"], e["element_type"], e["page_no"]) for e in found], "doc long, order_index int, content string, heading_level int, element_type string, page_no int")
    assert "# Public Data Policy" in markdown(rows, "doc").first()["markdown"]
    about = layout.titles(rows, "doc").first()
    assert (about["title"], about["page_count"]) == ("Public Data Policy", 1)
    assert about["clean_text"].startswith("Public Data Policy\nArticle 1")


def test_without_tables_text_stays(spark):
    found = run(spark, [(1, "Policy", 72, 20, 18.0), (1, "Metric", 202, 12, 11.0)])
    assert [e["content"] for e in found] == ["Policy", "Metric"]


def test_wrapped_blocks_join_and_new_paragraphs_do_not(spark):
    blocks = [(1, "标题", 10, 20, 18.0), (1, "本办法适用于全市", 40, 10, 11.0), (1, "公共数据。", 55, 10, 11.0), (1, "see the", 80, 10, 11.0), (1, "annex", 100, 10, 11.0), (1, "第二条 另一段", 112, 10, 11.0), (1, "far away", 200, 10, 11.0), (2, "next page", 0, 10, 11.0)]
    found = run(spark, blocks)
    assert [(e["content"], e["merged"]) for e in found] == [("标题", 1), ("本办法适用于全市公共数据。see the annex", 4), ("第二条 另一段", 1), ("far away", 1), ("next page", 1)]
    assert found[1]["bbox"] == {"x0": 50.0, "y0": 40.0, "x1": 500.0, "y1": 110.0}


def test_headings_and_their_parents(spark):
    blocks = [(1, "Title", 0, 10, 12.0), (1, "第一章 总则", 50, 10, 12.0), (1, "第一节 目的", 100, 10, 12.0), (1, "text", 150, 10, 12.0), (1, "Large one", 200, 10, 14.0), (1, "一、范围", 250, 10, 12.0), (2, "第二章 附则", 0, 10, 12.0)]
    found = run(spark, blocks)
    assert [(e["heading_level"], e["parent_index"]) for e in found] == [(1, None), (2, 0), (3, 1), (None, None), (2, 0), (3, 4), (2, 0)]


def test_a_title_is_made_where_none_is(spark):
    found = run(spark, [(1, "x" * 81, 0, 10, 12.0), (1, "y" * 90, 100, 10, 12.0)], names=[(1, " The   name ")])
    assert [(e["order_index"], e["element_type"], e["content"], e["generated"]) for e in found] == [(0, "title", "The name", True), (1, "paragraph", "x" * 81, False), (2, "paragraph", "y" * 90, False)]
    assert found[0]["bbox"] is None


def test_a_long_first_text_leaves_the_title_to_a_later_one(spark):
    found = run(spark, [(1, "x" * 81, 0, 10, None), (1, "Short", 100, 10, None)])
    assert [e["heading_level"] for e in found] == [None, 1]


def test_scanned_lines(spark):
    lines = spark.createDataFrame([(1, 1, "公共数据管理办法", 0.0, 0.0, 9.0, 10.0, 0.9), (1, 1, "第一条 为了", 0.0, 30.0, 9.0, 40.0, 0.8), (1, 1, "管理数据", 0.0, 56.0, 9.0, 66.0, 0.6), (1, 1, "较远", 0.0, 130.0, 9.0, 140.0, None)], SCHEMA.replace("size", "confidence"))
    out = layout.layout(lines, spark.createDataFrame([], TABLE), spark.createDataFrame([], "doc long, name string"), "doc", scanned=True).orderBy("order_index").collect()
    assert [(e["content"], e["confidence"]) for e in out] == [("公共数据管理办法", 0.9), ("第一条 为了管理数据", pytest.approx(0.7)), ("较远", None)]


def test_sweep_equals_comparing_all(spark):
    rng = random.Random(3)
    box = lambda: (lambda x, y: {"page": rng.randrange(3), "x0": x, "y0": y, "x1": x + rng.choice([0, 5, 30.0]), "y1": y + rng.choice([0, 3, 40.0])})(rng.randrange(50), rng.randrange(200))
    for _ in range(30):
        blocks, tables = [box() for _ in range(60)], [box() for _ in range(8)]

        def covered(b):
            area = max((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), 1.0)
            return any(t["page"] == b["page"] and max(0, min(b["x1"], t["x1"]) - max(b["x0"], t["x0"])) * max(0, min(b["y1"], t["y1"]) - max(b["y0"], t["y0"])) / area > 0.2 for t in tables)

        left = [b for b in blocks if not covered(b)]
        key = lambda b: sorted(b.items())
        assert sorted(layout.outside_tables(blocks, tables), key=key) == sorted(left, key=key)


def test_no_boxes_and_plan_of_one_pass(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = layout.layout(empty, spark.createDataFrame([], TABLE), spark.createDataFrame([(1, "n")], "doc long, name string"), "doc")
    assert out.count() == 0
    only_table = run(spark, [], [(1, 1, "a | b", 0.0, 0.0, 1.0, 1.0)])
    assert [(e["element_type"], e["generated"]) for e in only_table] == [("title", True), ("table", False)]
    assert out.where(F.lit(True))._jdf.queryExecution().toString().count("MapInArrow") >= 1
