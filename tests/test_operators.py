import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, evaluation, lists, metrics, retrieval, upsert


def test_upsert_null_keys_and_values(spark):
    target = spark.createDataFrame([("a", None, 1), ("b", 2020, 2)], "k string, y int, v int")
    source = spark.createDataFrame([("a", None, None), ("c", 1, 3)], "k string, y int, v int")
    got = {(r.k, r.y): (r.v, r._op) for r in upsert.upsert(target, source, ["k", "y"], ["v"]).collect()}
    assert got == {("a", None): (None, "updated"), ("b", 2020): (2, "kept"), ("c", 1): (3, "created")}
    again = upsert.upsert(target, target, ["k", "y"], ["v"], only_changes=True)
    assert {r._op for r in again.collect()} == {"kept"}


def test_paging(spark):
    page = lists.paged(spark.range(25), [F.col("id")], 3, 10).collect()
    assert [r.id for r in page] == [20, 21, 22, 23, 24] and {r.total for r in page} == {25}


def test_wide_metrics(spark):
    wide = spark.createDataFrame([("2024", "49,843.1", "2183.2", None), ("2025", "51000.0", "n/a", " ")], "`年份` string, GDP string, `常住人口` string, other string")
    assert not metrics.is_long(wide.columns)
    rows = metrics.mapped(metrics.unpivot_wide(wide, ["年份"], ["GDP", "常住人口", "other"])).collect()
    got = {(r["年份"], r.indicator_code): (r.value_numeric, r.value_text, r.unit) for r in rows}
    assert got == {("2024", "gdp_total"): (49843.1, None, "亿元"), ("2024", "resident_population"): (2183.2, None, "万人"), ("2025", "gdp_total"): (51000.0, None, "亿元"), ("2025", "resident_population"): (None, "n/a", "万人")}


def test_windows(spark):
    rows = spark.createDataFrame([(1, "x" * 1600), (2, "short"), (3, ""), (4, None), (5, "y" * 800)], "doc_id long, text string")
    got = [(r.doc_id, r.order_index, len(r.chunk_text)) for r in chunking.sliding_window(rows, "doc_id", "text").orderBy("doc_id", "order_index").collect()]
    assert got == [(1, 0, 800), (1, 1, 800), (1, 2, 192), (2, 0, 5), (5, 0, 800)]


def test_packing():
    assert chunking._pack(["a" * 200, "b" * 50, "c" * 100], 300, 800, 0.12) == [("paragraph", "a" * 200 + "\n\n" + "b" * 50 + "\n\n" + "c" * 100)]
    assert [s for s, _ in chunking._pack(["a" * 10, "b" * 900, "c"], 300, 800, 0.12)] == ["paragraph", "sliding_window", "sliding_window", "paragraph"]
    with pytest.raises(ValueError):
        chunking.check_options("section", 300, 800, 0.2)


def test_heading_paths(spark):
    lines = [(0, 1, "A"), (1, None, "t"), (2, 2, "B"), (3, 3, "C"), (4, 2, "D"), (5, None, "u"), (6, 1, "E"), (7, 3, "F")]
    rows = spark.createDataFrame([(1, *x) for x in lines], "k int, i int, level int, content string")
    got = [r.heading_path for r in chunking.heading_paths(rows, "k", "i", "level", "content").orderBy("i").collect()]
    assert got == ["A", "A", "A / B", "A / B / C", "A / D", "A / D", "E", "E / F"]


def test_reranking_caps_documents(spark):
    rows = spark.createDataFrame([(1, "d", 1.0), (2, "d", 0.9), (3, "d", 0.8), (4, "e", 0.7)], "id int, doc string, final_score double").withColumn("first_seen", F.struct(F.lit(0), F.col("id")))
    assert [r.id for r in retrieval.reranked(rows, "doc", 3).collect()] == [1, 2, 4]


def test_evaluation(spark):
    cases = spark.createDataFrame([("The Answer", ["answer", "none"], True), ("x", ["a", "b", "c"], True), ("x", [], False), (None, None, True)], "answer string, expected_keywords array<string>, route_ok boolean")
    out = evaluation.scored(cases)
    assert [r.passed for r in out.collect()] == [True, False, False, True]
    assert evaluation.pass_rate(out).first()[:] == (4, 2, 0.5)


def test_enqueue_checks_and_fills_in(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import jobs

    none = spark.createDataFrame([], "job_id int, job_type string, priority int, max_retries int, status string, retry_count int, progress int, created_at string, locked_by string")
    fresh = spark.createDataFrame([(1, "parse", None, None), (2, "embed", 1000, 0)], "job_id int, job_type string, priority int, max_retries int")
    got = jobs.enqueued(none, fresh, F.lit("now"), ("parse", "embed")).orderBy("job_id").collect()
    assert [(r.priority, r.max_retries, r.status, r.retry_count) for r in got] == [(100, 2, "pending", 0), (1000, 0, "pending", 0)]
    for bad in ((3, "parse", 1001, 1), (3, "parse", 1, -1), (3, "other", 1, 1)):
        with pytest.raises(Exception, match="no such job"):
            jobs.enqueued(none, spark.createDataFrame([bad], fresh.schema), F.lit("now"), ("parse", "embed")).collect()


def test_parts_of_answers(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import answers

    row = spark.createDataFrame([(["公共数据开放", " 数据安全 "], "q", ["b", "x", "b", "a"], ["a", "b"], "1e400", "7")], "t array<string>, q string, ids array<string>, c array<string>, big string, n string").select(
        answers.expanded_topics(F.col("t"), F.col("q")).alias("a"), answers.expanded_topics(F.lit(None).cast("array<string>"), F.col("q")).alias("b"), answers.known_ids(F.col("ids"), F.col("c")).alias("k"), answers.unknown_ids(F.col("ids"), F.col("c")).alias("u"), answers.number(F.col("big")).alias("f"), answers.number(F.col("n")).alias("n"), answers.number(F.col("q")).alias("z")
    ).first()
    assert tuple(row) == ("公共数据开放 公共数据资源 数据安全 分类分级", "q", ["b", "a"], ["x"], None, 7.0, None)
    assert [answers.field_type(x) for x in ("boolean", "decimal(5,2)", "int", "string", "date")] == ["boolean", "number", "number", "text", "text"]
    assert answers.quoted_identifier(" vw_x ") == '"vw_x"'
    with pytest.raises(ValueError):
        answers.quoted_identifier('a"b')
