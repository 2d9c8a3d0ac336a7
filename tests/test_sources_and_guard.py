import zipfile

import pytest

from lodestone.plans import guard, reporting
from lodestone.sources import pages, tabular
from lodestone.streaming import events

SF = "/root/testdata/sf0.001"


def test_csv_and_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name, n \n" x ",\n"q ""r""",2\n', encoding="utf-8")
    rows = tabular.read_tabular(spark, str(tmp_path / "a.csv"), "csv").collect()
    assert [tuple(r) for r in rows] == [("x", None), ('q "r"', "2")]
    with pytest.raises(ValueError):
        tabular.read_tabular(spark, "x", "pdf")
    assert tabular.decoded("统计".encode("gb18030")) == "统计" and tabular.decoded("﻿a".encode()) == "a"


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "m.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>年份</t></si><si><t>GDP</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>2024</v></c><c r="B2"><v>49843.1</v></c></row><row><c r="B3" t="inlineStr"><is><t> </t></is></c></row></sheetData></worksheet>')
    rows = tabular.read_tabular(spark, str(tmp_path / "m.xlsx"), "xlsx").collect()
    assert [(r.row_number, r.cells) for r in rows] == [(1, {"年份": "2024", "GDP": "49843.1"})]


def test_json_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"q": "a", "k": ["x"]}\n\n{"q": "b"}\n')
    rows = tabular.read_json_lines(spark, str(tmp_path / "c.jsonl"), "q string, k array<string>").collect()
    assert [tuple(r) for r in rows] == [("a", ["x"]), ("b", None)]


def test_page_elements():
    html = "<title>t</title><nav><p>no</p></nav><h1>A</h1><p>one <b>two</b></p><h2>B</h2><ul><li>x</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td></td></tr></table><script>var x='<p>';</script><h1>C</h1>"
    assert pages.elements_of(html) == [(0, "title", "A", 1, None), (1, "paragraph", "one two", None, 0), (2, "title", "B", 2, 0), (3, "paragraph", "x", None, 2), (4, "table", "a | b\n1", None, 2), (5, "title", "C", 1, None)]
    assert pages.elements_of("") == []


def test_pages_without_a_heading_and_noise():
    html = '<html><head><title> Open  data </title></head><body><div class="big toolbar"><p>no</p></div><p>yes</p><form><p>no</p></form><h2>Sub</h2><ul><li>item</li></ul></body></html>'
    assert pages.elements_of(html, "u") == [(0, "title", "Open data", 1, None), (1, "paragraph", "yes", None, None), (2, "title", "Sub", 2, None), (3, "paragraph", "item", None, 2)]
    assert pages.elements_of("<p>a</p>", "u")[0] == (0, "title", "u", 1, None)


def test_tables_in_scripts():
    html = """<html><head><title>Document</title></head><body><script>var data = {"templetname": "各市国民经济主要指标（2023年）", "fixedRowsTop": 2,
      "data": [["城市", "年末常住人口（万人）", "生产总值(亿元)", ""], ["", "", "", "第一产业"], ["杭州市", "1252.2", "20059", "347"], ["宁波市", "969.7", "16453", "384"]],
      "remark": "注：相关指标为2023年快报数据。"};</script></body></html>"""
    got = pages.elements_of(html)
    assert [x[1] for x in got] == ["title", "table", "table", "paragraph"] and all(x[4] == 0 for x in got[1:])
    assert got[1][2] == "城市=杭州市 | 年末常住人口（万人）=1252.2 | 生产总值(亿元)=20059 | 生产总值(亿元) / 第一产业=347"
    assert got[3][2] == "注：相关指标为2023年快报数据。"
    plain = pages.elements_of("<title>普通页面</title><script>var data = {invalid: true};</script><p>普通正文内容。</p>")
    assert plain == [(0, "title", "普通页面", 1, None), (1, "paragraph", "普通正文内容。", None, None)]


CASES = [
    ("select pg_sleep(1) as x from reporting.vw_value_yearly", ["BLOCKED_FUNCTION"]),
    ("select id from range(10)", ["FUNCTION_NOT_ALLOWED"]),
    ("select x from values (1) t(x)", ["TABLE_NOT_ALLOWED"]),
    ("select stat_year from reporting.vw_value_yearly tablesample (10 percent)", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year from reporting.vw_value_yearly where region_name collate unicode = 'a'", ["FUNCTION_NOT_ALLOWED"]),
    ("", ["EMPTY_SQL"]),
    ("select 1; drop table x", ["MULTI_STATEMENT"]),
    ("selec 1", ["PARSE_ERROR"]),
    ("drop table x", ["NON_SELECT_STATEMENT", "BLOCKED_STATEMENT"]),
    ("select * from reporting.vw_value_yearly", ["SELECT_STAR"]),
    ("select count(*) as n from reporting.vw_value_yearly", []),
    ("select stat_year from vw_value_yearly", ["SCHEMA_REQUIRED"]),
    ("select a from public.users", ["NON_REPORTING_SCHEMA"]),
    ("select a from reporting.users", ["TABLE_NOT_ALLOWED"]),
    ("select a from reporting.vw_value_yearly where b in (select c from other.t)", ["NON_REPORTING_SCHEMA"]),
    ("with q as (select * from reporting.vw_value_yearly) select stat_year from q", ["SELECT_STAR"]),
    ("select round(value_numeric) from reporting.vw_value_yearly", ["FUNCTION_NOT_ALLOWED"]),
    ("select cast(stat_year as string) as s from reporting.vw_value_yearly", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year from reporting.vw_value_yearly where exists (select region_name from reporting.vw_value_yearly)", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year from reporting.vw_value_yearly limit 1+1", ["INVALID_LIMIT"]),
    ("select stat_year from reporting.vw_value_yearly where region_name = 'a;b into c'", []),
    # nodes outside the allow list
    ("select struct(stat_year) as s from reporting.vw_value_yearly", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year from reporting.vw_value_yearly tablesample (10 rows)", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year from identifier('reporting.vw_value_yearly')", ["FUNCTION_NOT_ALLOWED"]),
    ("select identifier('stat_year') as b from reporting.vw_value_yearly", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year from reporting.vw_value_yearly version as of 1", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year from reporting.vw_value_yearly |> where stat_year > 1", ["FUNCTION_NOT_ALLOWED"]),
    ("select :p as a from reporting.vw_value_yearly", ["FUNCTION_NOT_ALLOWED"]),
    ("select first(stat_year) as b from reporting.vw_value_yearly", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year[0] as b from reporting.vw_value_yearly", ["FUNCTION_NOT_ALLOWED"]),
    ("select stat_year from stream reporting.vw_value_yearly", ["TABLE_NOT_ALLOWED"]),
    ("create table x as select stat_year from reporting.vw_value_yearly", ["NON_SELECT_STATEMENT", "BLOCKED_STATEMENT"]),
    # names of CTEs count where they can be seen
    ("select s.a from (with q as (select stat_year as a from reporting.vw_value_yearly) select a from q) s join q on true", ["SCHEMA_REQUIRED"]),
    ("with q as (select stat_year from r), r as (select stat_year from reporting.vw_value_yearly) select stat_year from q", ["SCHEMA_REQUIRED"]),
    ("with q as (with z as (select stat_year from reporting.vw_value_yearly) select stat_year from z) select stat_year from z", ["SCHEMA_REQUIRED"]),
    ("with q as (select stat_year from reporting.vw_value_yearly), r as (select stat_year from q) select q.stat_year from q join r on q.stat_year = r.stat_year", []),
    ("with recursive q(n) as (select 1 union all select n + 1 from q where n < 5) select n from q", []),
    # what may be written
    ("select stat_year from (select stat_year from reporting.vw_value_yearly limit 3) s limit 5", []),
    ("select /*+ coalesce(1) */ stat_year from reporting.vw_value_yearly t(stat_year)", []),
    ("select stat_year div 2 as d, stat_year & 1 as e from reporting.vw_value_yearly where region_name rlike 'a' or region_name like any ('b%', 'c') or stat_year <=> 1", []),
    ("select region_name, sum(value_numeric) over (partition by region_name order by stat_year rows between unbounded preceding and current row) as s from reporting.vw_value_yearly", []),
    ("select region_name, count(distinct stat_year) as n from reporting.vw_value_yearly group by grouping sets ((region_name), ()) having count(*) > 1 order by n desc nulls last", []),
]


@pytest.mark.parametrize("sql,want", CASES)
def test_guard(spark, sql, want):
    assert guard.validate(spark, sql).violations == want


def test_limits_and_execution(spark):
    reporting.publish(spark, SF)
    assert guard.validate(spark, "select stat_year from reporting.vw_value_yearly").limit == 100
    high = guard.validate(spark, "select dataset_name from reporting.vw_dataset_catalog limit 999")
    assert (high.limit, high.rewritten) == (200, True)
    out = guard.execute(spark, high, 60)
    assert out["row_count"] == 200 and len(out["preview"]) == 20 and out["columns"] == ["dataset_name"]
    assert out["executed_sql"] == high.sql and out["latency_ms"] >= 0
    with pytest.raises(PermissionError):
        guard.bounded(spark, guard.validate(spark, "select a from t"))
    own = guard.validate(spark, "select a from reporting.vw_custom limit 100", views=("vw_custom",), default_limit=25, max_limit=30)
    assert own.valid and own.limit == 30 and guard.validate(spark, "", views=()).messages == [("EMPTY_SQL", "SQL must not be empty")]
    kept = guard.bounded(spark, guard.validate(spark, "select 'reporting.vw_x' as s, `reporting`.`vw_value_yearly`.stat_year from `reporting`.`vw_value_yearly` /* reporting.vw_y */ limit 1")).first()
    assert kept.s == "reporting.vw_x"


def test_values_of_results_are_plain():
    from datetime import date, datetime
    from decimal import Decimal

    assert [guard.plain(x) for x in (Decimal("5.00"), Decimal("1.5"), date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), "x", None)] == [5, 1.5, "2024-01-02", "2024-01-02T03:04:05", "x", None]


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.file_stream(spark, str(tmp_path / "in"), source._jdf.schema().toDDL(), files=1)
    query = events.drain(events.tumbling(stream, late="60 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    query.stop()
    done = spark.read.schema("window_start timestamp, event_type string, n bigint, value double").parquet(str(tmp_path / "out"))
    batch = events.tumbling(source)
    # windows are written once the watermark has passed them
    assert done.exceptAll(batch).count() == 0
