"""The semantic catalogue: items of six families, their rebuild by what changed, and their search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, trimmed
from ..storage import fresh_path, written
from . import retrieval
from .embeddings import Provider, embed
from .upsert import one_a_key
from .versions import VersionedTable

TYPES = ("dataset", "table", "field", "metric", "sql_example", "business_rule")
KEYS = ["metadata_type", "name", "related_table", "related_field"]
COLUMNS = ["description", "aliases", "business_meaning", "unit", "time_grain", "ddl_snippet", "sql_example", "join_path", "search_text"]
BOOSTS = {"metric": 0.04, "table": 0.03, "field": 0.02}
VECTORS = "item_id string, embedding array<float>, embedding_model string, embedding_version string"
# The view and field that dataset items point at, the field of metrics, and the columns that a metric's text names.
CATALOG_VIEW, CATALOG_FIELD, METRIC_FIELD, METRIC_COLUMNS = "reporting.vw_dataset_catalog", "dataset_name", "value_numeric", "region_name, stat_year, value_numeric, unit"
NOTE = "name string, description string, aliases array<string>, business_meaning string, related_table string, related_field string, unit string, time_grain string, sql_example string"


def _given(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def _lines(*labelled: tuple[str, Column]) -> Column:
    """'label：value' lines; those that say nothing but a label are left out."""
    lines = [F.concat(F.lit(label + "："), F.coalesce(value, F.lit(""))) for label, value in labelled]
    return F.concat_ws("\n", *[F.when(~line.endswith("："), line) for line in lines])


def _names(*values: Column) -> Column:
    """Distinct trimmed names in order, without empty ones."""
    every = F.flatten(F.array(*[F.coalesce(v, F.array().cast("array<string>")) for v in values]))
    return F.array_distinct(F.filter(F.transform(every, trimmed), lambda x: x.isNotNull() & (x != "")))


def _one(value: Column) -> Column:
    return F.array(value)


def _family(rows: DataFrame, kind: str, first: Column, second: Column, **columns: Column) -> DataFrame:
    """Items of a family; where keys are equal the last by (first, second) counts, nulls last, then the larger text."""
    kinds = {c: "array<string>" if c == "aliases" else "string" for c in [*KEYS, *COLUMNS]}
    columns["metadata_type"] = F.lit(kind)
    for key in KEYS:
        columns[key] = F.coalesce(columns.get(key, F.lit("")).cast("string"), F.lit(""))
    picked = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    order = F.struct(first.isNull(), first.cast("string"), second.isNull(), second.cast("string"), columns["search_text"])
    return rows.select(*picked, order.alias("_order"))


def dataset_items(datasets: DataFrame) -> DataFrame:
    """One for each active dataset (dataset_name; category, department, open_type, description, status if there are)."""
    rows = datasets.where(F.coalesce(F.col("status") == "active", F.lit(False))) if "status" in datasets.columns else datasets
    given = {c: _given(rows, c) for c in ("dataset_name", "category", "department", "open_type", "description")}
    text = _lines(("类型", F.lit("数据集")), ("名称", given["dataset_name"]), ("分类", given["category"]), ("部门", given["department"]), ("开放类型", given["open_type"]), ("说明", given["description"]), ("可查询视图", F.lit(CATALOG_VIEW)))
    return _family(
        rows, "dataset", given["category"], given["dataset_name"], name=given["dataset_name"], related_table=F.lit(CATALOG_VIEW), related_field=F.lit(CATALOG_FIELD), description=given["description"],
        business_meaning=given["description"], aliases=_names(_one(given["dataset_name"]), _one(given["category"]), _one(given["department"])), search_text=text,
    )


def _named_views(views: DataFrame) -> DataFrame:
    enabled = views.where("enabled") if "enabled" in views.columns else views
    return enabled.withColumn("_full", F.concat(F.coalesce(_given(views, "schema_name"), F.lit("reporting")), F.lit("."), F.col("view_name")))


def table_items(views: DataFrame) -> DataFrame:
    """One for each enabled view of rows (view_name, field_name; a view without fields has one row with a null field)."""
    named = _named_views(views).withColumn("_about", _given(views, "view_description"))
    # as many names as the view has fields
    rows = named.groupBy("_full", "view_name").agg(F.max("_about").alias("_about"), F.array_join(F.array_sort(F.collect_list("field_name")), ", ").alias("_fields"))
    full, about, fields = F.col("_full"), F.col("_about"), F.col("_fields")
    ddl = F.concat(F.lit("CREATE VIEW "), full, F.lit(" ("), fields, F.lit(");"))
    text = _lines(("类型", F.lit("可查询视图")), ("名称", full), ("说明", about), ("字段", fields), ("DDL", ddl))
    return _family(rows, "table", full, full, name=full, related_table=full, description=about, business_meaning=about, aliases=F.array("view_name", full), ddl_snippet=ddl, search_text=text)


def field_items(views: DataFrame) -> DataFrame:
    """One for each field of an enabled view (field_type, description, example_value, is_dimension, is_measure if there are)."""
    rows = _named_views(views).where("field_name is not null")
    given = {c: _given(rows, c) for c in ("field_type", "description", "example_value")}
    full, name = F.col("_full"), F.col("field_name")
    text = _lines(
        ("类型", F.lit("字段")), ("视图", full), ("字段", name), ("字段类型", given["field_type"]), ("说明", given["description"]),
        ("是否维度", F.initcap(_given(rows, "is_dimension"))), ("是否指标", F.initcap(_given(rows, "is_measure"))), ("示例值", given["example_value"]),
    )
    aliases = F.when(F.coalesce(given["example_value"], F.lit("")) != "", F.array(name, given["example_value"])).otherwise(F.array(name))
    ddl = F.concat(name, F.lit(" "), F.coalesce(F.nullif(given["field_type"], F.lit("")), F.lit("text")))
    return _family(rows, "field", full, name, name=F.concat(full, F.lit("."), name), related_table=full, related_field=name, description=given["description"], business_meaning=given["description"], aliases=aliases, ddl_snippet=ddl, search_text=text)


def metric_items(metrics: DataFrame) -> DataFrame:
    """One for each metric (indicator_name, indicator_code; domain, unit, description, aliases and the view_name that shows it if there are)."""
    given = {c: _given(metrics, c) for c in ("indicator_name", "indicator_code", "domain", "unit", "description", "view_name")}
    view = F.coalesce(given["view_name"], F.lit(""))
    aliases = _names(_one(given["indicator_name"]), _one(given["indicator_code"]), _given(metrics, "aliases", "array<string>"))
    text = _lines(
        ("类型", F.lit("指标")), ("名称", given["indicator_name"]), ("指标编码", given["indicator_code"]), ("别名", F.array_join(aliases, "、")), ("领域", given["domain"]), ("单位", given["unit"]),
        ("说明", given["description"]), ("可查询视图", view), ("相关字段", F.lit(METRIC_COLUMNS)),
    )
    return _family(
        metrics, "metric", given["domain"], given["indicator_code"], name=given["indicator_name"], related_table=view, related_field=F.when(view != "", METRIC_FIELD), description=given["description"],
        business_meaning=given["description"], aliases=aliases, unit=given["unit"], time_grain=F.lit("annual"), search_text=text,
    )


def note_items(rows: DataFrame, kind: str) -> DataFrame:
    """SQL examples or business rules, written down by people (columns as in NOTE, those that are there)."""
    if kind not in ("sql_example", "business_rule"):
        raise ValueError(f"notes are sql_example or business_rule, not {kind}")
    given = {c: _given(rows, c) for c in ("name", "description", "business_meaning", "related_table", "related_field", "unit", "time_grain", "ddl_snippet", "sql_example", "join_path")}
    aliases = F.coalesce(_given(rows, "aliases", "array<string>"), F.array().cast("array<string>"))
    text = _lines(
        ("类型", F.lit(kind)), ("名称", given["name"]), ("别名", F.array_join(aliases, "、")), ("说明", given["description"]), ("业务口径", given["business_meaning"]),
        ("可查询视图", given["related_table"]), ("相关字段", given["related_field"]), ("SQL示例", given["sql_example"]),
    )
    return _family(rows, kind, given["name"], given["name"], aliases=aliases, search_text=text, **given)


def dataset_field_items(fields: DataFrame) -> DataFrame:
    """Fields of datasets (dataset_name, field_name, description) as items of their own."""
    text = _lines(("类型", F.lit("字段")), ("名称", F.col("dataset_name")), ("字段", F.col("field_name")), ("说明", F.col("description")))
    return _family(fields, "field", F.col("dataset_name"), F.col("field_name"), name=F.col("field_name"), related_table=F.col("dataset_name"), related_field=F.col("field_name"), description=F.col("description"), aliases=F.array("field_name"), search_text=text)


def items(datasets: DataFrame, fields: DataFrame | None, views: DataFrame, metrics: DataFrame, examples: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """item_id (hash of the keys), keys, columns and item_hash (of the columns) of all families. Null keys count as empty; rows without a name are left out."""
    families = [dataset_items(datasets), table_items(views), field_items(views), metric_items(metrics)]
    families += [dataset_field_items(fields)] if fields is not None else []
    families += [note_items(rows, kind) for kind, rows in (("sql_example", examples), ("business_rule", rules)) if rows is not None]
    every = families[0]
    for more in families[1:]:
        every = every.unionByName(more)
    one = one_a_key(every.where("name <> ''"), KEYS, "_order").drop("_order")
    return one.withColumn("item_id", content_hash(*[F.col(k) for k in KEYS])).withColumn("item_hash", F.sha2(F.to_json(F.struct(*COLUMNS)), 256))


def checked_types(types: tuple[str, ...] | list[str] | None) -> list[str]:
    """The families to rebuild: all, or those named, each once."""
    found = list(dict.fromkeys(TYPES if types is None else types))
    if not found or any(t not in TYPES for t in found):
        raise ValueError(f"types must be some of {', '.join(TYPES)}")
    return found


def change_set(current: DataFrame, embedded: DataFrame, fresh: DataFrame, provider: Provider, types: tuple[str, ...] | list[str] | None = None, force: bool = False) -> DataFrame:
    """Items after the rebuild with _op (created, updated, kept) and _vector (new, replaced, reused; null outside the types).

    Hashes decide what changed: one outer join by item_id, one by what has a vector of the provider's model and version. Items that `fresh` lacks stay as they were.
    """
    chosen = checked_types(types)
    held = ["item_hash", *KEYS, *COLUMNS]
    old = current.select("item_id", F.struct(*held).alias("old"))
    new = fresh.where(F.col("metadata_type").isin(chosen)).select("item_id", F.struct(*held).alias("new"))
    op = F.when(F.col("old").isNull(), "created").when(F.col("new.item_hash") != F.col("old.item_hash"), "updated").otherwise("kept")
    merged = old.join(new, "item_id", "full_outer").select("item_id", F.coalesce("new", "old").alias("r"), op.alias("_op")).select("item_id", "r.*", "_op")
    mine = embedded.where((F.col("embedding_model") == provider.model) & (F.col("embedding_version") == provider.version)).select("item_id", F.lit(True).alias("_has")).distinct()
    stale = F.lit(True) if force else F.col("_op") != "kept"
    vector = F.when(F.col("metadata_type").isin(chosen), F.when(F.col("_has").isNull(), "new").when(stale, "replaced").otherwise("reused"))
    return merged.join(mine, "item_id", "left").withColumn("_vector", vector).drop("_has")


def rebuild(current: DataFrame, embedded: DataFrame, fresh: DataFrame, provider: Provider, types: tuple[str, ...] | list[str] | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items as in change_set, embeddings). Only new and replaced items are embedded; vectors of other models and versions stay.

    The change set is written once in the shared folder: items, vectors and counts read the same decisions.
    """
    decided = written(change_set(current, embedded, fresh, provider, types, force), fresh_path(fresh.sparkSession, "semantic"))
    gone = decided.where("_vector = 'replaced'").select("item_id", F.lit(provider.model).alias("embedding_model"), F.lit(provider.version).alias("embedding_version"))
    left = embedded.join(gone, ["item_id", "embedding_model", "embedding_version"], "left_anti")
    return decided, left.unionByName(embed(decided.where("_vector in ('new', 'replaced')"), provider, "item_id", "search_text"))


def counts(decided: DataFrame) -> DataFrame:
    """One row: what a rebuild did to the items of its types."""
    of = lambda c, *values: F.count_if(F.col(c).isin(*values))
    return decided.where("_vector is not null").agg(
        F.count(F.lit(1)).alias("item_count"), of("_op", "created").alias("items_created"), of("_op", "updated").alias("items_updated"),
        of("_vector", "new", "replaced").alias("embeddings_created"), of("_vector", "reused").alias("embeddings_reused"), of("_vector", "replaced").alias("embeddings_deleted"),
    )


def rebuild_tables(held: VersionedTable, vectors: VersionedTable, fresh: DataFrame, provider: Provider, types: tuple[str, ...] | list[str] | None = None, force: bool = False) -> DataFrame:
    """rebuild over two tables in versions; gives the counts.

    Vectors are swapped first: a run that ends between the swaps leaves the old items, whose changes the next run finds and embeds again. The other way round stale vectors would pass for right ones.
    """
    spark: SparkSession = fresh.sparkSession
    current = held.read() if held.current() else spark.createDataFrame([], fresh.schema)
    embedded = vectors.read() if vectors.current() else spark.createDataFrame([], VECTORS)
    decided, after = rebuild(current, embedded, fresh, provider, types, force)
    vectors.write(after)
    held.write(decided.drop("_op", "_vector"))
    return counts(decided)


def search(items_: DataFrame, embedded: DataFrame, query: str, vector: list[float], types: tuple[str, ...] = (), k: int = 8) -> DataFrame:
    rows = items_.where(F.col("metadata_type").isin(*types)) if types else items_
    text = F.concat_ws("\n", "name", "search_text", "related_table", "related_field")
    vectors = embedded.join(rows.select("item_id"), "item_id")
    branches = {"dense": retrieval.dense(vectors, vector, "item_id", "embedding"), "keyword": retrieval.keyword(rows, query, text, "item_id"), "fulltext": retrieval.tokens(rows, query, text, "item_id")}
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv])[F.col("metadata_type")], F.lit(0.0))
    found = retrieval.merged(branches, "item_id").join(rows, "item_id").withColumn("final_score", retrieval.final_score(retrieval.SEMANTIC, boost))
    return found.orderBy(F.desc("final_score"), F.asc("first_seen")).limit(min(50, max(1, k)))
