import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators import semantic
from lodestone.operators.embeddings import HashingProvider
from lodestone.operators.versions import VersionedTable

VIEW = "view_id int, schema_name string, view_name string, view_description string, enabled boolean, field_name string, field_type string, description string, example_value string, is_dimension boolean, is_measure boolean"


class Marked:
    """A provider whose vectors say which run made them."""

    def __init__(self, mark: float, version: str = "1"):
        self.model, self.version, self.dim, self.mark = "marked", version, 2, mark

    def embed(self, texts):
        return [[self.mark, float(len(t))] for t in texts]


def sources(spark, unit="people", more=()):
    datasets = spark.createDataFrame([("roads", "traffic", "works", "open", "all roads", "active"), ("gone", "x", "y", "open", "z", "archived"), (" rivers ", None, None, None, None, "active"), ("unsaid", None, None, None, None, None), *more], "dataset_name string, category string, department string, open_type string, description string, status string")
    views = spark.createDataFrame([(1, "reporting", "pop", "by year", True, "value", "double", "how many", "3", False, True), (1, "reporting", "pop", "by year", True, "year", None, None, None, True, False), (2, "reporting", "off", None, False, "x", None, None, None, None, None), (3, None, "bare", None, True, None, None, None, None, None, None)], VIEW)
    metrics = spark.createDataFrame([("residents", "pop_total", "population", unit, None, "reporting.pop", ["people", " residents ", ""]), ("spare", "s", "other", None, None, None, None)], "indicator_name string, indicator_code string, domain string, unit string, description string, view_name string, aliases array<string>")
    examples = spark.createDataFrame([("by year", "a trend", ["trend"], None, "reporting.pop", None, None, "annual", "SELECT 1")], semantic.NOTE)
    rules = spark.createDataFrame([("keep units", "say them", ["unit"], "no mixing", "reporting", "unit", None, None, None)], semantic.NOTE)
    return semantic.items(datasets, None, views, metrics, examples, rules)


def test_items_of_six_families(spark):
    got = {(r.metadata_type, r.name): r for r in sources(spark).collect()}
    assert set(got) == {("dataset", "roads"), ("dataset", " rivers "), ("table", "reporting.pop"), ("table", "reporting.bare"), ("field", "reporting.pop.value"), ("field", "reporting.pop.year"), ("metric", "residents"), ("metric", "spare"), ("sql_example", "by year"), ("business_rule", "keep units")}
    roads = got["dataset", "roads"]
    assert roads.search_text == "类型：数据集\n名称：roads\n分类：traffic\n部门：works\n开放类型：open\n说明：all roads\n可查询视图：reporting.vw_dataset_catalog"
    assert (roads.aliases, roads.related_field) == (["roads", "traffic", "works"], "dataset_name") and got["dataset", " rivers "].aliases == ["rivers"]
    pop = got["table", "reporting.pop"]
    assert pop.ddl_snippet == "CREATE VIEW reporting.pop (value, year);" and pop.search_text.split("\n")[3] == "字段：value, year"
    assert got["table", "reporting.bare"].search_text == "类型：可查询视图\n名称：reporting.bare\nDDL：CREATE VIEW reporting.bare ();"
    value, year = got["field", "reporting.pop.value"], got["field", "reporting.pop.year"]
    assert value.search_text == "类型：字段\n视图：reporting.pop\n字段：value\n字段类型：double\n说明：how many\n是否维度：False\n是否指标：True\n示例值：3"
    assert (value.aliases, value.ddl_snippet, year.aliases, year.ddl_snippet) == (["value", "3"], "value double", ["year"], "year text")
    residents, spare = got["metric", "residents"], got["metric", "spare"]
    assert residents.search_text == "类型：指标\n名称：residents\n指标编码：pop_total\n别名：residents、pop_total、people\n领域：population\n单位：people\n可查询视图：reporting.pop\n相关字段：region_name, stat_year, value_numeric, unit"
    assert (residents.related_field, residents.time_grain, spare.related_table, spare.related_field) == ("value_numeric", "annual", "", "")
    assert got["sql_example", "by year"].search_text.split("\n")[-1] == "SQL示例：SELECT 1" and "相关字段" not in got["sql_example", "by year"].search_text
    assert got["business_rule", "keep units"].search_text == "类型：business_rule\n名称：keep units\n别名：unit\n说明：say them\n业务口径：no mixing\n可查询视图：reporting\n相关字段：unit"


def test_the_last_of_equal_keys_counts_whatever_the_partitions(spark):
    rows = [("a", c, None, None, d, "active") for c, d in (("x", "1"), (None, "2"), ("y", "3"))]
    for order in (rows, rows[::-1]):
        one = semantic.dataset_items(spark.createDataFrame(order, "dataset_name string, category string, department string, open_type string, description string, status string").repartition(3))
        got = semantic.one_a_key(one, semantic.KEYS, "_order").collect()
        assert [r.description for r in got] == ["2"]


def counted(df):
    return tuple(df.first())


def test_only_changes_are_embedded_again(spark):
    held, vectors = (VersionedTable(spark, storage.fresh_path(spark, n)) for n in ("items", "vectors"))
    assert counted(semantic.rebuild_tables(held, vectors, sources(spark), Marked(1.0))) == (10, 10, 0, 10, 0, 0)
    assert counted(semantic.rebuild_tables(held, vectors, sources(spark), Marked(2.0))) == (10, 0, 0, 0, 10, 0)
    changed = sources(spark, unit="heads", more=[("new", None, None, None, None, "active")])
    assert counted(semantic.rebuild_tables(held, vectors, changed, Marked(3.0))) == (11, 1, 1, 2, 9, 1)
    marks = vectors.read().join(held.read(), "item_id").select("name", F.col("embedding")[0].alias("mark")).collect()
    assert len(marks) == 11 and {r.name for r in marks if r.mark == 3.0} == {"residents", "new"} and all(r.mark in (1.0, 3.0) for r in marks)
    # another version: everything anew, the old version's vectors stay
    assert counted(semantic.rebuild_tables(held, vectors, changed, Marked(4.0, "2"))) == (11, 0, 0, 11, 0, 0)
    assert vectors.read().count() == 22
    # some types, by force: other families and other versions are left alone
    assert counted(semantic.rebuild_tables(held, vectors, changed, Marked(5.0, "2"), ["metric", "metric"], force=True)) == (2, 0, 0, 2, 0, 2)
    assert vectors.read().where("embedding[0] = 5").count() == 2 and vectors.read().count() == 22
    # what the sources lack now stays an item
    assert counted(semantic.rebuild_tables(held, vectors, sources(spark, unit="heads"), Marked(6.0, "2"))) == (11, 0, 0, 0, 11, 0)


def test_a_run_that_ends_between_the_swaps_is_made_good(spark, monkeypatch):
    held, vectors = (VersionedTable(spark, storage.fresh_path(spark, n)) for n in ("items", "vectors"))
    semantic.rebuild_tables(held, vectors, sources(spark), Marked(1.0))
    with monkeypatch.context() as m:
        m.setattr(held, "write", lambda df: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            semantic.rebuild_tables(held, vectors, sources(spark, unit="heads"), Marked(2.0))
    assert counted(semantic.rebuild_tables(held, vectors, sources(spark, unit="heads"), Marked(3.0))) == (10, 0, 1, 1, 9, 1)
    assert vectors.read().count() == 10 and vectors.read().where("embedding[0] = 3").count() == 1


def test_types_and_empty_tables(spark):
    for wrong in ([], ["other"]):
        with pytest.raises(ValueError):
            semantic.checked_types(wrong)
    with pytest.raises(ValueError):
        semantic.note_items(spark.createDataFrame([], semantic.NOTE), "metric")
    fresh = sources(spark)
    none, no_vectors = spark.createDataFrame([], fresh.schema), spark.createDataFrame([], semantic.VECTORS)
    items, vectors = semantic.rebuild(none, no_vectors, none, HashingProvider(4))
    assert items.count() == 0 and vectors.count() == 0 and counted(semantic.counts(items)) == (0, 0, 0, 0, 0, 0)
