import json

import pytest
from pyspark.sql import functions as F

from lodestone.plans import contracts

ROUTE = {"route_type": "DATA_QA", "needs_policy_evidence": False, "needs_data_analysis": True, "confidence": 0.9, "reason": "r"}
SQL = {"sql": "select 1", "reason": "r", "confidence": 1}
RAG = {"answer": "a", "evidence_sufficient": True}

CASES = [
    ("QuestionRoute", ROUTE, []),
    ("QuestionRoute", ROUTE | {"extra": 1, "extracted_entities": {"region": None, "normalized_time_range": {"start_year": 2020, "end_year": "2021", "grain": "year"}}}, []),
    ("QuestionRoute", ROUTE | {"confidence": 1.2}, ["$.confidence: not from 0 to 1"]),
    ("QuestionRoute", ROUTE | {"confidence": "0.3", "needs_data_analysis": "yes", "needs_policy_evidence": 1}, []),
    ("QuestionRoute", ROUTE | {"confidence": "high", "reason": 5}, ["$.confidence: no number", "$.reason: no text"]),
    ("QuestionRoute", ROUTE | {"extracted_entities": None}, ["$.extracted_entities: null"]),
    ("QuestionRoute", ROUTE | {"extracted_entities": {"normalized_time_range": {"grain": "week", "start_year": 1.5, "confidence": -1}}}, ["$.extracted_entities.normalized_time_range.start_year: no whole number", "$.extracted_entities.normalized_time_range.grain: no such option", "$.extracted_entities.normalized_time_range.confidence: not from 0 to 1"]),
    ("QuestionRoute", {k: v for k, v in ROUTE.items() if k != "route_type"}, ["$.route_type: missing"]),
    ("SqlGenerationResult", SQL, []),
    ("SqlGenerationResult", SQL | {"sql": "  "}, ["$.sql: empty"]),
    ("SqlGenerationResult", SQL | {"sql": None, "used_metadata_ids": "m1"}, ["$.sql: missing", "$.used_metadata_ids: no list"]),
    ("SqlGenerationResult", SQL | {"used_metadata_ids": []}, []),
    ("RagAnswer", RAG | {"citations": [{"source_id": "s", "source_title": "t", "quote": "q"}, {"source_id": 1, "source_title": "t"}, "no"], "caveat": None}, ["$.citations[1].source_id: no text", "$.citations[1].quote: missing", "$.citations[2]: no object"]),
    ("RagAnswer", RAG | {"suggested_followups": ["a", None]}, ["$.suggested_followups: not all texts"]),
    ("ChartSpec", {"chart_type": "donut", "title": "t", "reason": "r"}, ["$.chart_type: no such option"]),
    ("HybridAnswer", {"answer": "a", "used_sql": True, "used_policy_evidence": "maybe", "data_sources": [{}]}, ["$.data_sources[0].title: missing", "$.used_policy_evidence: no truth value"]),
    ("SqlResultExplanation", {"summary": "s", "data_sources": {}}, ["$.data_sources: no list"]),
]


@pytest.mark.parametrize("name", sorted({c[0] for c in CASES}))
def test_rules(spark, name):
    mine = [(i, json.dumps(output)) for i, (n, output, _) in enumerate(CASES) if n == name]
    got = spark.createDataFrame(mine, "i int, output string").select("i", contracts.violations(F.col("output"), name).alias("v")).collect()
    assert {r["i"]: sorted(r["v"]) for r in got} == {i: sorted(CASES[i][2]) for i, _ in mine}


def test_what_is_no_object(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", "  ", "{", "[]", "1", "null", "```json\n{}\n```")], "output string")
    assert {tuple(r[0]) for r in rows.select(contracts.violations(F.col("output"), "ChartSpec")).collect()} == {("$: no object",)}
    with pytest.raises(ValueError):
        contracts.violations(F.col("output"), "Other")


def test_answers_are_asked_for_again(spark):
    good = json.dumps(SQL)

    def provider(prompts):
        return [good if p == "easy" or "$.sql: empty" in p and '"sql": ""' in p else json.dumps(SQL | {"sql": ""}) if p.startswith("hard") else None for p in prompts]

    prompts = spark.createDataFrame([(1, "easy"), (2, "hard"), (3, "never")], "id long, prompt string")
    got = {r["id"]: (r["output"], r["violations"], r["retry_count"]) for r in contracts.answered(prompts, provider, "SqlGenerationResult").collect()}
    assert got == {1: (good, [], 0), 2: (good, [], 1), 3: (None, ["$: no object"], 1)}
    assert contracts.answered(prompts, provider, "SqlGenerationResult", 0).where("retry_count = 0").count() == 3
    with pytest.raises(ValueError):
        contracts.answered(prompts, provider, "SqlGenerationResult", -1)


def test_known_ids_and_structs(spark):
    row = spark.sql("select array('b', 'x', 'a', 'x') as used, array('a', 'b') as allowed").select(contracts.known_ids(F.col("used"), F.col("allowed")).alias("k")).first()["k"]
    assert (row["valid"], row["unknown"]) == (["b", "a"], ["x", "x"])
    assert spark.createDataFrame([(json.dumps(SQL),)], "o string").select(contracts.parsed(F.col("o"), "sql string, confidence double").alias("p")).first()["p"].asDict() == {"sql": "select 1", "confidence": 1.0}
