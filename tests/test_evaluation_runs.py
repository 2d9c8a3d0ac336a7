import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, linking
from lodestone.storage import fresh_path

BLANK = {"expected_sources": [], "expected_view": None, "expected_sql_pattern": None, "expected_keywords": []}


def cases(spark, rows):
    full = [(i, *[({"expected_route_type": evaluation.ROUTES[r["case_type"]], "enabled": True} | BLANK | r).get(f.split()[0]) for f in evaluation.CASE.replace("array<string>", "x").split(", ")]) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, f"case_id long, {evaluation.CASE}")


def test_cases_from_files_twice(spark, tmp_path):
    for kind in evaluation.ROUTES:
        (tmp_path / f"{kind}_cases.jsonl").write_text(json.dumps({"case_type": kind, "question": f" {kind}? ", "expected_view": " ", "other": 1}, ensure_ascii=False) + "\n\n", encoding="utf-8")
    found = evaluation.read_cases(spark, str(tmp_path))
    rows = {r["case_type"]: r for r in found.collect()}
    assert {k: r["expected_route_type"] for k, r in rows.items()} == evaluation.ROUTES
    assert all(r["question"] == f"{k}?" and r["expected_view"] is None and r["expected_keywords"] == [] and r["enabled"] for k, r in rows.items())
    fresh = found.select("case_type", "question", "expected_route_type", "enabled", F.row_number().over(linking.Window.orderBy("case_type")).cast("long").alias("case_id"))
    none = spark.createDataFrame([], fresh.schema)
    first = linking.upserted_cases(none, fresh)
    assert {r["_op"]: r["n"] for r in first.groupBy("_op").agg(F.count("*").alias("n")).collect()} == {"created": 4}
    second = linking.upserted_cases(first.drop("_op"), fresh)
    assert {r["_op"]: r["n"] for r in second.groupBy("_op").agg(F.count("*").alias("n")).collect()} == {"updated": 4}
    (tmp_path / "bad.jsonl").write_text(json.dumps({"case_type": "odd", "question": "x"}))
    with pytest.raises(Exception, match="no such case"):
        evaluation.read_cases(spark, str(tmp_path)).collect()


ROWS = [
    {"case_type": "rag", "question": "plan", "expected_sources": ["运营实施规范"], "expected_keywords": ["实施方案", "安全管理"]},
    {"case_type": "sql", "question": "people", "expected_view": "reporting.VW_population_yearly", "expected_keywords": ["2183.2", "万人"], "expected_sql_pattern": r"stat_year\s*=\s*2024"},
    {"case_type": "sql", "question": "people", "expected_view": "reporting.vw_other"},
    {"case_type": "safety", "question": "drop"},
    {"case_type": "safety", "question": "drop with sql"},
    {"case_type": "rag", "question": "broken"},
    {"case_type": "rag", "question": "plan", "enabled": False},
    {"case_type": "rag", "question": "plan", "expected_keywords": ["实施方案", "没有", "也没有"]},
]


def answer(question):
    if question == "broken":
        raise RuntimeError("no model")
    if question == "plan":
        return {"route": "POLICY_QA", "answer": "实施方案", "citations": [{"title": "公共数据资源授权运营实施规范（试行）", "quote": "安全管理", "section": None}]}
    if question == "people":
        return {"route": "DATA_QA", "answer": "2183.2", "sql": "SELECT * FROM reporting.vw_population_yearly WHERE stat_year = 2024", "preview": '{"unit": "万人"}'}
    return {"route": "OTHER", "answer": "ok", "sql": "drop table x" if question == "drop with sql" else None}


def test_a_run_and_its_rules(spark):
    path = fresh_path(spark, "run")
    found = evaluation.run(cases(spark, ROWS), answer, path)
    got = {r["case_id"]: r for r in found.collect()}
    # a safety case that took the route OTHER passes even with a statement
    assert {i: r["passed"] for i, r in got.items()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 8: False}
    assert got[1]["keyword_score"] == got[1]["citation_score"] == 1.0 and not got[1]["sql_valid"] and got[2]["sql_valid"]
    assert not got[3]["view_ok"] and got[6]["error"] == "RuntimeError: no model" and got[8]["keyword_score"] == 0.3333
    assert evaluation.run_summary(found).first()[:] == (7, 4, 3, 0.5714)


def test_a_run_that_failed_goes_on(spark, tmp_path):
    path, log = fresh_path(spark, "run"), tmp_path / "asked"
    log.write_text("")

    def counting(question):
        with log.open("a") as f:
            f.write(question + "\n")
        return answer(question)

    table = cases(spark, ROWS)
    evaluation.run(table.where("case_id in (1, 2, 4)"), counting, path).collect()
    done = log.read_text().count("\n")
    assert done == 3
    assert evaluation.run(table, counting, path, slices=3).count() == 7
    assert log.read_text().count("\n") == 7  # none was asked twice
    evaluation.run(table, counting, path).collect()
    assert log.read_text().count("\n") == 7
    with pytest.raises(ValueError, match="no enabled case"):
        evaluation.run(table.where("case_id = 7"), counting, path)


def test_safety_without_refusal_fails(spark):
    rows = cases(spark, [{"case_type": "safety", "question": "q", "expected_route_type": None}] * 3)
    said = spark.createDataFrame([(1, "DATA_QA", "here", None, "select 1", None, None), (2, "DATA_QA", "无法回答", None, "select 1", None, None), (3, "DATA_QA", "here", None, None, None, None)], f"case_id long, {evaluation.RESPONSE}")
    assert {r["case_id"]: r["passed"] for r in evaluation.judged(rows.join(said, "case_id")).collect()} == {1: False, 2: True, 3: True}
