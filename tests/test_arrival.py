import json

from pyspark.sql import functions as F

from lodestone.operators import documents, imports
from lodestone.sources import tabular

DATASET = "dataset_name string, field_name string, field_type string, description string, example_value string, is_dimension boolean, is_measure boolean"


def catalogue(tmp_path):
    """Two files: the later one repeats names of the first, and a name under two addresses."""
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "a.csv").write_text("dataset_name,source_url,category,note\n" + "".join(f"d{i % 50},u,{i},n{i}\n" for i in range(400)))
    (tmp_path / "cat" / "b.csv").write_text("dataset_name,source_url,category,note\nd0,u,late,x\nd1,w,other,y\nd1,u,back,z\nd1,w,last,q\n")
    (tmp_path / "fields.csv").write_text("dataset_name,field_name,description\nd1,f,one\nd1,f,two\nd2,f,three\nold,f,x\n,f,y\nd3,,z\n")
    return str(tmp_path / "cat"), str(tmp_path / "fields.csv")


def test_winners_whatever_the_partitions(spark, tmp_path):
    cat, fields = catalogue(tmp_path)
    raw, raw_fields = tabular.read_csv(spark, cat, numbered=True), tabular.read_csv(spark, fields, numbered=True)
    held = spark.createDataFrame([("old", "u", None)], "dataset_name string, source_url string, x string")
    for deal in (lambda df: df, lambda df: df.repartition(7, F.rand(3)), lambda df: df.orderBy(F.rand(5))):
        target = imports.catalogue_rows(deal(raw)).drop("_row").limit(0).unionByName(held.select("dataset_name", "source_url"), allowMissingColumns=True)
        got = imports.import_datasets(target, spark.createDataFrame([], DATASET), deal(raw), deal(raw_fields))
        found = {(r.dataset_name, r.source_url): (r.category, r.metadata) for r in got.tables["datasets"].collect()}
        assert found["d0", "u"] == ("late", '{"note":"x"}') and found["d1", "w"][0] == "last" and found["d1", "u"][0] == "back"
        assert all(found[f"d{i}", "u"][0] == str(350 + i) for i in range(2, 50)) and len(found) == 52
        # d1's last row is the one under w; the file has no dataset `old`, two rows lack a name
        assert {(r.dataset_name, r.source_url, r.description) for r in got.tables["fields"].collect()} == {("d1", "w", "two"), ("d2", "u", "three")}
        assert got.counts["skipped"].first()[0] == 3


def test_lines_of_a_file_that_many_tasks_read(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n\n".join(json.dumps({"k": i % 7, "v": i}) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = tabular.read_json_lines(spark, str(tmp_path / "m.jsonl"), "k int, v int", numbered=True)
        assert rows.rdd.getNumPartitions() > 8
        got = rows.repartition(5, F.rand(1)).groupBy("k").agg(F.max_by("v", "_arrival").alias("last"), F.min_by("v", "_arrival").alias("first")).collect()
        assert {(r.k, r.first, r.last) for r in got} == {(k, k, max(i for i in range(5000) if i % 7 == k)) for k in range(7)}
        assert [r.v for r in rows.orderBy("_arrival").collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_metric_rows_left_out_are_counted(spark, tmp_path):
    (tmp_path / "m.csv").write_text("indicator_code,indicator_name,stat_year,value_numeric\ng,first,2020,1\ng,second,2020,2\n,x,2020,1\nh, ,2020,1\n")
    raw = tabular.read_csv(spark, str(tmp_path / "m.csv"), numbered=True).repartition(3, F.rand(2))
    metrics = spark.createDataFrame([], "indicator_code string, indicator_name string, domain string, unit string")
    values = spark.createDataFrame([], "indicator_code string, region_code string, stat_period string, stat_year int, stat_month int, data_version string, region_name string, value_numeric double, value_text string, unit string")
    got = imports.import_metrics(metrics, values, raw)
    assert [(r.indicator_name) for r in got.tables["metrics"].collect()] == ["first"] and [r.value_numeric for r in got.tables["values"].collect()] == [2.0]
    assert got.counts["skipped"].first()[0] == 2
    wide = spark.createDataFrame([("2020", "1")], "year string, GDP string")
    assert imports.import_metrics(metrics, values, wide).counts["skipped"].first()[0] == 0


def test_versions_by_arrival(spark):
    versions = spark.createDataFrame([("d", "h")], "document_id string, content_hash string")
    incoming = spark.createDataFrame([("d", "b", 2, "x"), ("d", "a", 3, "x"), ("d", "b", 1, "y"), ("e", "", 5, None), ("d", "c", 3, "x")], "document_id string, clean_text string, at int, have string").repartition(4, F.rand(1))
    got = documents.numbered_versions(versions, incoming, "at").collect()
    assert {(r.document_id, r.clean_text, r.at, r.have) for r in got} == {("d", "b", 1, "y"), ("d", "a", 3, "x"), ("d", "c", 3, "x"), ("e", "", 5, None)}
    numbers = {(r.document_id, r.clean_text): r.version_no for r in got}
    assert numbers["d", "b"] == "v2" and {numbers["d", "a"], numbers["d", "c"]} == {"v3", "v4"} and numbers["e", ""] == "v1"
    assert documents.numbered_versions(versions, incoming.limit(0), "at").count() == 0
