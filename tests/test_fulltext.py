import hashlib
import math
import re
from collections import Counter

import pytest

from lodestone.operators import fulltext, retrieval
from lodestone.operators.fulltext import Index
from lodestone.storage import fresh_path, written

TEXTS = [(1, "Solar power, solar roofs."), (2, "Wind power and solar power"), (3, None), (4, ""), (5, "wind Wind WIND a_b 2024 é"), (6, "power"), (None, "power lost")]


@pytest.fixture
def index(spark):
    index = Index(spark, fresh_path(spark, "fulltext"), 4)
    index.add(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    return index


def brute(texts, query):
    words = {d: re.findall(r"\w+", (t or "").lower()) for d, t in texts if d is not None}
    asked = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    df = {t: sum(t in w for w in words.values()) for t in asked}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    out = {}
    for d, w in words.items():
        tf = Counter(w)
        if asked and all(tf[t] for t in asked):
            out[d] = round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in asked), 6)
    return out


def found(df):
    return {r["doc"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize("query", ["power", "Solar POWER", "power solar wind", "wind é 2024 a_b", "absent power", "", "。"])
def test_equals_reading_all_texts(index, query):
    assert found(index.search(query)) == pytest.approx(brute(TEXTS, query))


def test_changed_texts_replace_and_known_ones_add_nothing(spark, index):
    changed = [(1, "Solar power, solar roofs."), (2, "nothing left"), (7, "new power")]
    index.add(spark.createDataFrame(changed, "doc_id long, text string"))
    assert index.batches[2] == {"batch": 2, "texts": 2, "words": 4, "gone": 1, "gone_words": 5}
    now = [x for x in TEXTS if x[0] not in (2,)] + changed[1:]
    for query in ("power", "solar power", "nothing"):
        assert found(index.search(query)) == pytest.approx(brute(now, query))
    index.add(spark.createDataFrame(TEXTS[:2], "doc_id long, text string"))
    assert found(index.search("solar power")) == pytest.approx(brute([*TEXTS, (7, "new power")], "solar power"))


def test_a_batch_that_failed_is_not_seen(spark, index, monkeypatch):
    before = found(index.search("power"))
    monkeypatch.setattr(fulltext, "removed", lambda *_: None)
    columns = DataFrameWriterFailing(index)
    with pytest.raises(RuntimeError):
        columns.add(spark.createDataFrame([(9, "power power")], "doc_id long, text string"))
    assert found(index.search("power")) == before
    assert index.add(spark.createDataFrame([(9, "power power")], "doc_id long, text string")) == 3
    assert found(index.search("power")) == pytest.approx(brute([*TEXTS, (9, "power power")], "power"))


class DataFrameWriterFailing:
    """Leaves a batch behind that has its words and postings, but no row in `batches`."""

    def __init__(self, index):
        self.index = index

    def add(self, texts):
        spark, path = self.index.spark, self.index.path
        written(texts.selectExpr("doc_id as doc", "'x' as hash", "cast(null as int) as old"), f"{path}/words/batch=2")
        spark.sql("select 'power' as term, 9L as doc, 2 as batch, 2 as tf, 2 as length, array(0, 1) as positions, 2 as part, 0 as bucket").withColumn("bucket", fulltext.F.lit(self.index.bucket("power"))).write.mode("append").partitionBy("part", "bucket").parquet(f"{path}/postings")
        raise RuntimeError


def test_phrases_by_position(index):
    assert {r["doc"]: r["n"] for r in index.phrase("solar power").collect()} == {1: 1, 2: 1}
    assert {r["doc"]: r["n"] for r in index.phrase("wind wind").collect()} == {5: 2}
    assert index.phrase("power solar roofs").count() == 1
    assert index.phrase("roofs power").count() == 0


def test_only_the_terms_buckets_are_opened(index):
    plan = index.search("solar wind")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)
    assert "In(term, [solar,wind])" in plan
    assert "positions" not in re.findall(r"ReadSchema: struct<term[^>]*>", plan)[0]


def test_retrieval_takes_the_index(spark, index):
    rows = spark.createDataFrame([(d, d, t, "t", "", None, "active", "published", None) for d, t in TEXTS if d and t], "chunk_id long, document_id long, retrieval_text string, title string, document_no string, policy_level string, validity_status string, publish_status string, publish_date date")
    vectors = spark.createDataFrame([(d, "m", "1", [1.0, 0.0]) for d in (1, 2, 5, 6)], "chunk_id long, embedding_model string, embedding_version string, embedding array<double>")
    hits = retrieval.retrieve(rows, vectors, "solar power", [1.0, 0.0], "m", "1", index=index).collect()
    s = brute(TEXTS, "solar power")
    assert {h["chunk_id"]: h["token_score"] for h in hits if h["token_score"]} == {d: pytest.approx(x / (1 + x), abs=1e-6) for d, x in s.items()}
    assert all("fulltext" in h["sources"] for h in hits if h["chunk_id"] in s)


def test_effective_dates(spark):
    rows = spark.sql("select 1 as id, date'2024-01-05' as effective_date union all select 2, date'2024-03-01' union all select 3, null")
    kept = lambda **how: {r["id"] for r in retrieval.policy_filter(rows, published_only=False, validity=(), **how).collect()}
    assert kept(effective_since="2024-02-01") == {2}
    assert kept(effective_until="2024-02-01") == {1}
    assert kept(effective_since="2024-01-01", effective_until="2024-12-31") == {1, 2}


def test_empty_table(spark):
    index = Index(spark, fresh_path(spark, "fulltext"))
    index.add(spark.createDataFrame([], "doc_id long, text string"))
    assert index.search("power").count() == 0
    assert index.frequencies().count() == 0


def test_postings_are_made_where_a_text_is_read(monkeypatch):
    monkeypatch.setattr(fulltext, "WORDS", 4)
    texts = [(7, ["b", "a", "b"]), (8, []), (9, ["a"]), (10, ["c"] * 6), (11, [])]
    batch = fulltext.pa.RecordBatch.from_pylist([{"doc": d, "words": w} for d, w in texts], fulltext.pa.schema([("doc", fulltext.pa.int64()), ("words", fulltext.pa.list_(fulltext.pa.string()))]))
    got = {(r["term"], r["doc"], r["length"], tuple(r["positions"])) for b in fulltext._postings(iter([batch, batch.slice(1, 1)])) for r in b.to_pylist()}
    assert got == {("b", 7, 3, (0, 2)), ("a", 7, 3, (1,)), ("a", 9, 1, (0,)), ("c", 10, 6, tuple(range(6)))}


def test_repeated_ids_count_once(spark):
    index = Index(spark, fresh_path(spark, "fulltext"), 4)
    rows = [(1, "sun"), (1, "sun"), (2, "moon"), (2, "sun sun"), (3, "sun")]
    for _ in range(2):
        index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = [(1, "sun"), (3, "sun"), min(((2, t) for t in ("moon", "sun sun")), key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())]
    assert index.batches[1]["texts"] == 3 and index.batches[2]["texts"] == 0
    assert found(index.search("sun")) == pytest.approx(brute(kept, "sun"))
