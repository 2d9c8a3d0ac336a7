"""The library's queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import answers, questions, text, vectors
from .operators import chunking, documents, embeddings, evaluation, fulltext, jobs, layout, linking, lists, metrics, retrieval, semantic, upsert, versions
from .plans import contracts, generated, guard, reporting
from .sources import pages as html_pages
from .storage import fresh_path
from .streaming import events as event_streams
from .streaming import traces, uploads, worker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


# Reporting views

VALUE_YEARLY = """SELECT CAST(r_regionkey AS BIGINT) AS region_code, r_name AS region_name, CAST(year(o_orderdate) AS BIGINT) AS stat_year,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value_numeric, count(*) AS n_orders, 'order_value' AS indicator_name, 'USD' AS unit
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
STATS = "SELECT {by}, count(*) AS dataset_count, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS api_count, max(n_chars) AS latest FROM (SELECT lang AS category, source AS department, n_chars FROM documents) GROUP BY {by}"


@query(VALUE_YEARLY)
def reporting_value_yearly(spark, sf_dir):
    return reporting.value_yearly(spark, sf_dir)


@query("SELECT 'doc-' || doc_id AS dataset_name, lang AS category, source AS department, n_chars AS api_count FROM documents")
def reporting_catalog(spark, sf_dir):
    return reporting.dataset_catalog(spark, sf_dir)


@query(STATS.format(by="category"))
def reporting_category_stats(spark, sf_dir):
    return reporting.category_stats(spark, sf_dir)


@query(STATS.format(by="department"))
def reporting_department_stats(spark, sf_dir):
    return reporting.department_stats(spark, sf_dir)


@query()
def reporting_fields(spark, sf_dir):
    return reporting.catalog(spark, sf_dir)


# Governed statements: the same text runs on both engines

GOVERNED = {
    "guard_select_limit": "SELECT region_name, stat_year, value_numeric FROM reporting.vw_value_yearly WHERE stat_year BETWEEN 1994 AND 1997 AND NOT region_name LIKE 'A%' ORDER BY stat_year, region_name LIMIT 7",
    "guard_cte": "WITH y AS (SELECT stat_year, sum(n_orders) AS n FROM reporting.vw_value_yearly GROUP BY stat_year) SELECT stat_year, n FROM y WHERE n > 10",
    "guard_subquery_in": "SELECT region_name, stat_year FROM reporting.vw_value_yearly WHERE stat_year IN (SELECT max(stat_year) FROM reporting.vw_value_yearly)",
    "guard_cube": "SELECT region_name, stat_year, sum(n_orders) AS n FROM reporting.vw_value_yearly WHERE stat_year > 1996 GROUP BY CUBE (region_name, stat_year)",
    "guard_rollup": "SELECT region_name, stat_year, sum(n_orders) AS n FROM reporting.vw_value_yearly WHERE stat_year > 1996 GROUP BY ROLLUP (region_name, stat_year)",
    "guard_grouping_sets": "SELECT region_name, stat_year, sum(n_orders) AS n FROM reporting.vw_value_yearly GROUP BY GROUPING SETS ((region_name), (stat_year), ())",
    "guard_intersect": "WITH e AS (SELECT region_name FROM reporting.vw_value_yearly WHERE stat_year = 1995 INTERSECT SELECT region_name FROM reporting.vw_value_yearly WHERE stat_year = 1997) SELECT region_name FROM e",
    "guard_right_join": "SELECT a.category, b.department, b.dataset_count FROM reporting.vw_category_stats a RIGHT JOIN reporting.vw_department_stats b ON a.dataset_count = b.dataset_count",
    "guard_scalar_subquery": "SELECT region_name, stat_year, n_orders - (SELECT min(n_orders) FROM reporting.vw_value_yearly) AS above FROM reporting.vw_value_yearly",
    "guard_predicates": "SELECT region_name, stat_year, region_name || '!' AS shout FROM reporting.vw_value_yearly WHERE (region_name ILIKE 'a%' OR region_name IN ('EUROPE')) AND NOT stat_year = 1996 AND value_numeric IS NOT NULL",
    "guard_window_sum": "SELECT region_name, stat_year, sum(n_orders) OVER (PARTITION BY region_name ORDER BY stat_year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM reporting.vw_value_yearly",
    "guard_setop_in_cte": "WITH u AS (SELECT region_name FROM reporting.vw_value_yearly WHERE stat_year = 1995 UNION SELECT department FROM reporting.vw_department_stats), e AS (SELECT region_name FROM u EXCEPT SELECT department FROM reporting.vw_department_stats WHERE dataset_count > 40) SELECT region_name FROM e",
    "guard_count_distinct": "SELECT count(DISTINCT region_name) AS regions, count(*) FILTER (WHERE stat_year > 1996) AS late FROM reporting.vw_value_yearly",
    "guard_left_join": "SELECT a.category, b.department, b.dataset_count FROM reporting.vw_category_stats a LEFT JOIN reporting.vw_department_stats b ON a.dataset_count = b.dataset_count",
    "guard_full_join": "SELECT a.category, b.department FROM reporting.vw_category_stats a FULL JOIN reporting.vw_department_stats b ON a.latest = b.latest",
    "guard_theta_join": "SELECT a.category, b.department FROM reporting.vw_category_stats a JOIN reporting.vw_department_stats b ON a.dataset_count > b.dataset_count AND a.latest > b.latest",
    "guard_having": "SELECT region_name, min(value_numeric) AS low, max(value_numeric) AS high FROM reporting.vw_value_yearly GROUP BY region_name HAVING count(*) > 3 ORDER BY low DESC NULLS LAST",
    "guard_distinct": "SELECT DISTINCT stat_year % 3 AS rest, stat_year - 1900 AS short FROM reporting.vw_value_yearly WHERE region_name IS NOT NULL ORDER BY short DESC NULLS LAST LIMIT 5 OFFSET 1",
}


def _governed(statement: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reporting.publish(spark, sf_dir)
        return guard.bounded(spark, guard.validate(spark, statement))

    return run


def _plain(statement: str) -> str:
    views = {"vw_value_yearly": VALUE_YEARLY, "vw_category_stats": STATS.format(by="category"), "vw_department_stats": STATS.format(by="department")}
    out = statement
    for name, sql in views.items():
        out = out.replace(f"reporting.{name}", f"({sql})")
    return out


for _name, _statement in GOVERNED.items():
    QUERIES[_name] = _governed(_statement)
for _name, _statement in GOVERNED.items():
    # sums of counts are wider in DuckDB
    ORACLES[_name] = _plain(_statement).replace("sum(n_orders) AS n", "CAST(sum(n_orders) AS BIGINT) AS n").replace("CURRENT ROW) AS running", "CURRENT ROW)::BIGINT AS running")


@query()
def guard_violations(spark, sf_dir):
    """What the guard says of statements that it must turn down, and of one that it accepts."""
    statements = ["", "SELECT 1; SELECT 2", "SELEC 1", "DROP TABLE t", "SELECT * FROM reporting.vw_value_yearly", "SELECT stat_year FROM vw_value_yearly", "SELECT a FROM other.t", "SELECT a FROM reporting.hidden", "SELECT upper(region_name) FROM reporting.vw_value_yearly", "SELECT stat_year FROM reporting.vw_value_yearly LIMIT 10 + 1", "SELECT a INTO b FROM reporting.vw_value_yearly", "SELECT stat_year FROM reporting.vw_value_yearly UNION SELECT 1", "SELECT stat_year FROM reporting.vw_value_yearly LIMIT 500"]
    found = [guard.validate(spark, s) for s in statements]
    return spark.createDataFrame([(s, ",".join(g.violations), g.limit, g.rewritten) for s, g in zip(statements, found, strict=True)], "statement string, violations string, row_limit int, rewritten boolean")


# Lists


@query("SELECT p_partkey, p_name, CAST((SELECT count(*) FROM part) AS BIGINT) AS total FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def paged_list(spark, sf_dir):
    return lists.paged(load(spark, sf_dir, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 3, 20)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%r_d%' OR p_brand ILIKE '%r_d%' OR p_type ILIKE '%r_d%'")
def keyword_filter_list(spark, sf_dir):
    return lists.keyword_filter(load(spark, sf_dir, "part"), "r_d", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY segment DESC NULLS LAST, c_custkey LIMIT 50")
def nulls_last_sort(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return rows.orderBy(F.desc_nulls_last("segment"), "c_custkey").limit(50)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 30")
def offset_limit(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(30).limit(10)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01'")
def optional_filters(spark, sf_dir):
    rows = load(spark, sf_dir, "orders")
    return lists.all_of(rows, F.col("o_orderstatus") == "O", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderdate") >= "1997-01-01", None).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"SELECT region_name, sum(n_orders)::BIGINT AS n FROM ({VALUE_YEARLY}) GROUP BY region_name ORDER BY n DESC, region_name LIMIT 3")
def top_regions(spark, sf_dir):
    return reporting.value_yearly(spark, sf_dir).groupBy("region_name").agg(F.sum("n_orders").alias("n")).orderBy(F.desc("n"), "region_name").limit(3)


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top_k_per_group(spark, sf_dir):
    rows = lists.top_per_group(load(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    return rows.select("o_custkey", "o_orderkey", "o_totalprice", big("rank"))


# Imports and upserts


@query("""SELECT p_partkey, indicator_name, value_numeric, value_text FROM (
  SELECT p_partkey, 'p_size' AS indicator_name, CAST(p_size AS DOUBLE) AS value_numeric, CAST(NULL AS VARCHAR) AS value_text FROM part UNION ALL
  SELECT p_partkey, 'p_retailprice', p_retailprice, NULL FROM part UNION ALL SELECT p_partkey, 'p_brand', NULL, p_brand FROM part)""")
def unpivot_wide_metrics(spark, sf_dir):
    return metrics.unpivot_wide(load(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice", "p_brand"]).select("p_partkey", "indicator_name", "value_numeric", "value_text")


@query("SELECT 'p_size' AS indicator_name, 'p_size' AS indicator_code, '' AS unit, count(*) AS n FROM part UNION ALL SELECT 'gdp', 'gdp_total', '亿元', count(*) FROM part")
def metric_mapping(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("gdp"))
    return metrics.mapped(metrics.unpivot_wide(rows, ["p_partkey"], ["p_size", "gdp"])).groupBy("indicator_name", "indicator_code", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'updated' WHEN o_orderkey % 3 = 0 THEN 'created' ELSE 'kept' END AS op
  FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def upsert_metrics(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    out = upsert.upsert(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 3 = 0").withColumn("status", F.lit(None).cast("string")), ["o_orderkey"], ["status"])
    return out.withColumnRenamed("_op", "op")


@query("""WITH t AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey, 'F' AS s FROM orders WHERE o_orderkey % 3 = 0)
  SELECT CASE WHEN t.o_orderkey IS NULL THEN 'created' WHEN n.o_orderkey IS NOT NULL AND t.s IS DISTINCT FROM n.s THEN 'updated' ELSE 'kept' END AS op, count(*) AS n FROM t FULL JOIN n USING (o_orderkey) GROUP BY op""")
def upsert_changes(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    out = upsert.upsert(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 3 = 0").withColumn("status", F.lit("F")), ["o_orderkey"], ["status"], only_changes=True)
    return upsert.counters(out).withColumnRenamed("_op", "op")


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey")
def upsert_first_wins(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return upsert.one_a_key(rows, ["o_custkey"], "o_orderkey", last=False).select("o_custkey", "status", "price")


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def upsert_last_wins(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), "o_orderkey")
    return upsert.one_a_key(rows, ["o_custkey"], "o_orderkey").select("o_custkey", "status")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_pending(spark, sf_dir):
    return upsert.pending(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_reused(spark, sf_dir):
    return upsert.reused(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels"), "doc_id")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedupe(spark, sf_dir):
    return upsert.first_by_hash(load(spark, sf_dir, "documents").where("text is not null"), F.col("text"), "doc_id")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, value AS number, CAST(ts AS DATE) AS day, event_type = 'click' AS clicked FROM events")
def clean_coercions(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("  "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("　")).alias("v"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("d"), F.when(F.col("event_type") == "click", "Yes").otherwise("").alias("b"))
    return rows.select("event_id", text.parse_int(F.col("v")).alias("whole"), text.parse_float(F.col("v")).alias("number"), text.parse_date(F.col("d")).alias("day"), text.parse_bool(F.col("b")).alias("clicked"))


# Vectors and retrieval

QUERY_VECTOR = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_Q = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]"
_COS = f"round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6)"
QUESTION = "the reentthe that thoring hefor licensed under"
_TERMS = ["the", "reentthe", "that", "thoring", "hefor", "licensed", "under"]
_LOW = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_KW = "round((" + " + ".join(f"(contains({_LOW}, '{t}'))::INT" for t in _TERMS) + f") / {len(_TERMS)}, 6)"


@query(f"SELECT vec_id, {_COS} AS dense_score FROM embeddings ORDER BY dense_score DESC, vec_id LIMIT 20")
def dense_topk(spark, sf_dir):
    return retrieval.dense(load(spark, sf_dir, "embeddings"), QUERY_VECTOR, "vec_id", "embedding", 20)


@query(f"SELECT vec_id, {_COS} AS dense_score FROM embeddings WHERE label = 3 ORDER BY dense_score DESC, vec_id LIMIT 20")
def dense_topk_filtered(spark, sf_dir):
    return retrieval.dense(load(spark, sf_dir, "embeddings").where("label = 3"), QUERY_VECTOR, "vec_id", "embedding", 20)


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))), 6) AS first, 16 AS dim FROM embeddings")
def mrl_resize(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", vectors.resized(F.col("embedding"), 16).alias("v"))
    return rows.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.size("v").alias("dim"))


@query("SELECT UNNEST(['the', 'reentthe', 'that', 'thoring', 'hefor', 'licensed', 'under']) AS term")
def query_terms(spark, sf_dir):
    return spark.range(1).select(F.explode(text.query_terms(F.lit(QUESTION))).alias("term"))


@query(f"SELECT doc_id, {_KW} AS keyword_score FROM documents")
def keyword_scores(spark, sf_dir):
    rows = load(spark, sf_dir, "documents")
    return rows.select("doc_id", F.round(text.keyword_score(F.col("text"), text.terms_of(QUESTION)), 6).alias("keyword_score"))


_PRE = "(20 * contains(lower(text), 'licensed under')::INT + contains(lower(text), 'licensed')::INT + contains(lower(text), 'under')::INT)"


@query(f"SELECT doc_id, {_PRE}::BIGINT AS prefilter_rank FROM documents WHERE {_PRE} > 0 ORDER BY prefilter_rank DESC, doc_id LIMIT 200")
def keyword_prefilter(spark, sf_dir):
    rows = retrieval.prefiltered(load(spark, sf_dir, "documents"), "licensed under", {"text": 1}, "doc_id", 20)
    return rows.select("doc_id", big("prefilter_rank"))


def _hybrid(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    vecs = load(spark, sf_dir, "embeddings").join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi").withColumnRenamed("vec_id", "doc_id")
    branches = {
        "dense": retrieval.dense(vecs, QUERY_VECTOR, "doc_id", "embedding"),
        "keyword": retrieval.keyword(docs, QUESTION, F.col("text"), "doc_id"),
    }
    out = retrieval.merged(branches, "doc_id").join(docs.select("doc_id", "source", "quality"), "doc_id")
    bonus = retrieval.metadata_score(F.when(F.col("quality") == 1, "active").otherwise("unknown"), F.lit("published"), F.lit("city"), None)
    return out.withColumn("final_score", retrieval.final_score(retrieval.POLICY, bonus))


_EXACT = f"contains({_LOW}, '{QUESTION}')::INT::DOUBLE"
_HYBRID = f"""d AS (SELECT doc_id, text, source, quality FROM documents JOIN labels USING (doc_id)),
  a AS (SELECT vec_id AS doc_id, {_COS} AS dense_score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM d) ORDER BY dense_score DESC, vec_id LIMIT 20),
  b AS (SELECT doc_id, {_KW} AS keyword_score, {_EXACT} AS exact_score FROM d WHERE {_KW} > 0 OR {_EXACT} > 0 ORDER BY exact_score DESC, keyword_score DESC, doc_id LIMIT 20),
  ra AS (SELECT *, 0 AS branch, row_number() OVER (ORDER BY dense_score DESC, doc_id) AS place FROM a), rb AS (SELECT *, 1 AS branch, row_number() OVER (ORDER BY keyword_score DESC, exact_score DESC, doc_id) AS place FROM b),
  m AS (SELECT doc_id, coalesce(dense_score, 0) AS dense_score, coalesce(keyword_score, 0) AS keyword_score, coalesce(exact_score, 0) AS exact_score,
    CASE WHEN ra.doc_id IS NULL THEN 'keyword' WHEN rb.doc_id IS NULL THEN 'dense' ELSE 'dense,keyword' END AS sources, coalesce(ra.branch, rb.branch) AS branch, CASE WHEN ra.doc_id IS NULL THEN rb.place ELSE ra.place END AS place FROM ra FULL JOIN rb USING (doc_id)),
  f AS (SELECT m.*, source, quality, round(0.62::DOUBLE * dense_score + 0.22::DOUBLE * keyword_score + 0.25::DOUBLE * exact_score + CASE WHEN quality = 1 THEN 0.08::DOUBLE ELSE 0.03::DOUBLE END + 0.04::DOUBLE, 6) AS final_score FROM m JOIN d USING (doc_id))"""


@query(f"WITH {_HYBRID} SELECT doc_id, dense_score, keyword_score, exact_score, sources, final_score FROM f")
def hybrid_retrieve(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("doc_id", "dense_score", "keyword_score", "exact_score", "sources", "final_score")


@query(f"WITH {_HYBRID} SELECT doc_id, source, final_score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY final_score DESC, branch, place) AS n FROM f) WHERE n <= 2 ORDER BY final_score DESC, branch, place LIMIT 8")
def rerank_cap(spark, sf_dir):
    return retrieval.reranked(_hybrid(spark, sf_dir), "source").select("doc_id", "source", "final_score")


@query(f"WITH {_HYBRID} SELECT s AS source_label, count(*) AS n FROM (SELECT unnest(string_split(sources, ',')) AS s FROM f) GROUP BY s")
def source_counts(spark, sf_dir):
    return _hybrid(spark, sf_dir).select(F.explode(F.split("sources", ",")).alias("source_label")).groupBy("source_label").agg(F.count(F.lit(1)).alias("n"))


@query()
def token_match(spark, sf_dir):
    return retrieval.tokens(load(spark, sf_dir, "documents"), "licensed under the", F.col("text"), "doc_id")


# Chunks and pages

_WINDOWS = """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS order_index, piece AS chunk_text FROM (
  SELECT doc_id, i, regexp_replace(regexp_replace(substr(text, (i * 704 + 1)::BIGINT, 800), '^[\\s]+', ''), '[\\s]+$', '') AS piece
  FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 800) / 704.0))::BIGINT + 1)) AS i FROM documents WHERE text IS NOT NULL)) WHERE piece <> ''"""


@query(_WINDOWS)
def chunk_sliding_window(spark, sf_dir):
    return chunking.sliding_window(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", big("order_index"), "chunk_text")


@query(f"""SELECT doc_id, order_index, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM (
  SELECT doc_id, order_index, sha256(concat_ws(chr(10), doc_id::VARCHAR, order_index::VARCHAR, 'sliding_window', '', chunk_text)) AS chunk_id FROM ({_WINDOWS})) WINDOW w AS (PARTITION BY doc_id ORDER BY order_index)""")
def chunk_links(spark, sf_dir):
    chunks = chunking.sliding_window(load(spark, sf_dir, "documents"), "doc_id", "text")
    return chunking.linked(chunks, "doc_id").select("doc_id", big("order_index"), "chunk_id", "prev_chunk_id", "next_chunk_id")


def _lines(spark, sf_dir):
    """Each document's lines as elements; a line ending without a period, of at most 40 characters, is a title."""
    rows = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return rows.withColumn("title", (F.length("line") <= 40) & ~F.col("line").endswith("."))


@query("""SELECT doc_id, idx, sum(title::INT) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS section FROM (
  SELECT doc_id, generate_subscripts(l, 1)::BIGINT - 1 AS idx, unnest(l) AS line, length(line) <= 40 AND line NOT LIKE '%.' AS title FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""")
def chunk_section(spark, sf_dir):
    return chunking.sections(_lines(spark, sf_dir), "doc_id", "idx", "title").select("doc_id", big("idx"), big("section"))


_BLANK = r"'^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{3000}]+$', '', 'g'"
# a chunk is marked by its first letter: p of paragraphs, s of windows
_WINDOWS = f"list_transform(list_filter(list_transform(generate_series(0, length(e.b) - 97, 704), lambda i: regexp_replace(substring(e.b, i + 1, 800), {_BLANK})), lambda w: w <> ''), lambda w: 's' || w)"


@query(f"""SELECT doc_id, CAST(place - 1 AS BIGINT) AS order_index, CASE WHEN c[1] = 'p' THEN 'paragraph' ELSE 'sliding_window' END AS strategy, c[2:] AS chunk_text FROM (
  SELECT doc_id, generate_subscripts(cs, 1) AS place, unnest(cs) AS c FROM (SELECT doc_id, CASE WHEN r.b <> '' THEN r.o || ['p' || r.b] ELSE r.o END AS cs FROM (
    SELECT doc_id, list_reduce(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, {_BLANK})), lambda l: l <> ''), lambda l: {{'b': l, 'o': []::VARCHAR[]}}),
      lambda a, e: CASE WHEN length(e.b) > 800 THEN {{'b': '', 'o': a.o || CASE WHEN a.b <> '' THEN ['p' || a.b] ELSE []::VARCHAR[] END || {_WINDOWS}}}
        WHEN a.b <> '' AND length(a.b) + 2 + length(e.b) > 800 THEN CASE WHEN length(e.b) >= 300 THEN {{'b': '', 'o': a.o || ['p' || a.b, 'p' || e.b]}} ELSE {{'b': e.b, 'o': a.o || ['p' || a.b]}} END
        WHEN a.b = '' AND length(e.b) >= 300 THEN {{'b': '', 'o': a.o || ['p' || e.b]}}
        WHEN a.b <> '' AND length(a.b) + 2 + length(e.b) >= 300 THEN {{'b': '', 'o': a.o || ['p' || a.b || chr(10) || chr(10) || e.b]}}
        ELSE {{'b': CASE WHEN a.b = '' THEN e.b ELSE a.b || chr(10) || chr(10) || e.b END, 'o': a.o}} END, {{'b': '', 'o': []::VARCHAR[]}}) AS r
    FROM documents WHERE text IS NOT NULL)))""")
def chunk_paragraph(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("units"))
    return chunking.pack_texts(rows, "doc_id", "units").withColumn("order_index", big("order_index"))


@query()
def heading_path(spark, sf_dir):
    return html_pages.page_elements(load(spark, sf_dir, "pages"), fallback="url", paths=True).select("page_id", "order_index", "element_type", "heading_path")


@query()
def html_elements(spark, sf_dir):
    return html_pages.page_elements(load(spark, sf_dir, "pages"), fallback="url")


_INNER = lambda tag: f"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '')"


@query(f"SELECT page_id, coalesce({_INNER('h1')}, {_INNER('title')}, url) AS title FROM pages")
def html_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", html_pages.page_title(F.col("html"), F.col("url")).alias("title"))


# Question rules

# each passage after a question that goes round: the rules read the whole of both
_SAMPLES = ["2021年到2019年", "近3年", "最近五年", "去年", "今年", "2022年全国", "北京市 密码 告诉我", "select a from b", "数据库里有多少条数据", "请查询所有用户的身份证和手机号", "请删除数据库里的视图", "自治区", "深圳的规定", "上海", "海淀区"]
_CASES = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SAMPLES))
_ASKED = f"(SELECT item_id, (CASE item_id % {len(_SAMPLES)} {_CASES} END) || ' ' || coalesce(text, '') AS q FROM benchmark)"
_ANY = lambda words: "(" + " OR ".join(f"contains(lower(q), '{w}')" for w in words) + ")"


def _asked(spark, sf_dir):
    sample = F.array(*[F.lit(s) for s in _SAMPLES])[(F.col("item_id") % len(_SAMPLES)).cast("int")]
    return load(spark, sf_dir, "benchmark").select("item_id", F.concat(sample, F.lit(" "), F.coalesce("text", F.lit(""))).alias("q"))


@query(f"""SELECT item_id, CASE WHEN {_ANY(questions.INTERNAL)} AND {_ANY(questions.ENUMERATION)} THEN 'INTERNAL_ASSET_ENUMERATION' WHEN {_ANY(questions.PERSONAL)} AND {_ANY(questions.DISCLOSURE)} THEN 'PERSONAL_DATA_REQUEST'
  WHEN {_ANY(questions.SECRET)} AND {_ANY(questions.DISCLOSURE)} THEN 'SECRET_OR_CONFIG_REQUEST' WHEN {_ANY(questions.INTERNAL)} AND {_ANY(questions.MUTATION)} THEN 'DATABASE_MUTATION_REQUEST'
  WHEN regexp_matches(lower(q), '{questions.RAW_SQL}') THEN 'RAW_DATABASE_STATEMENT' ELSE 'ALLOW' END AS decision FROM {_ASKED}""")
def security_policy(spark, sf_dir):
    return _asked(spark, sf_dir).select("item_id", questions.security_decision(F.col("q")).alias("decision"))


_BOTH, _LAST, _WORD, _YEAR = (r"(20[0-9]{2})\s*年?\s*(?:到|至|~|-|—)\s*(20[0-9]{2})", r"(?:近|最近)\s*([0-9]{1,2})\s*年", r"(?:近|最近)\s*([一二三四五六七八九十两])\s*年", r"(20[0-9]{2})\s*年")


@query(f"""SELECT item_id, CASE WHEN both1 <> '' THEN least(both1::INT, both2::INT) WHEN last <> '' THEN 2026 - last::INT + 1 WHEN word = '两' THEN 2025 WHEN word <> '' THEN 2026 - strpos('{questions.NUMERALS}', word)::INT + 1
    WHEN contains(q, '去年') THEN 2025 WHEN contains(q, '今年') THEN 2026 WHEN one <> '' THEN one::INT END AS start_year,
  CASE WHEN both1 <> '' THEN greatest(both1::INT, both2::INT) WHEN last <> '' OR word <> '' THEN 2026 WHEN contains(q, '去年') THEN 2025 WHEN contains(q, '今年') THEN 2026 WHEN one <> '' THEN one::INT END AS end_year
  FROM (SELECT *, regexp_extract(q, '{_BOTH}', 1) AS both1, regexp_extract(q, '{_BOTH}', 2) AS both2, regexp_extract(q, '{_LAST}', 1) AS last, regexp_extract(q, '{_WORD}', 1) AS word, regexp_extract(q, '{_YEAR}', 1) AS one FROM {_ASKED})""")
def time_range(spark, sf_dir):
    return _asked(spark, sf_dir).withColumn("r", questions.time_range(F.col("q"), 2026)).select("item_id", "r.start_year", "r.end_year")


_LEVEL = " ".join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{level}'" for level, words in questions.LEVELS)


@query(f"SELECT item_id, CASE {_LEVEL} END AS level FROM {_ASKED}")
def policy_level(spark, sf_dir):
    return _asked(spark, sf_dir).select("item_id", questions.policy_level(F.col("q")).alias("level"))


# Semantic items

# by value: what the reporting views show
_VIEW_FIELDS = """(VALUES ('vw_value_yearly', 'region_code', 'bigint'), ('vw_value_yearly', 'region_name', 'string'), ('vw_value_yearly', 'stat_year', 'bigint'), ('vw_value_yearly', 'value_numeric', 'double'), ('vw_value_yearly', 'n_orders', 'bigint'),
  ('vw_value_yearly', 'indicator_name', 'string'), ('vw_value_yearly', 'unit', 'string'), ('vw_dataset_catalog', 'dataset_name', 'string'), ('vw_dataset_catalog', 'category', 'string'), ('vw_dataset_catalog', 'department', 'string'), ('vw_dataset_catalog', 'api_count', 'bigint'),
  ('vw_category_stats', 'category', 'string'), ('vw_category_stats', 'dataset_count', 'bigint'), ('vw_category_stats', 'api_count', 'bigint'), ('vw_category_stats', 'latest', 'bigint'),
  ('vw_department_stats', 'department', 'string'), ('vw_department_stats', 'dataset_count', 'bigint'), ('vw_department_stats', 'api_count', 'bigint'), ('vw_department_stats', 'latest', 'bigint')) f(v, field_name, field_type)"""
_LINES = "array_to_string(list_filter([{}], lambda x: NOT ends_with(x, '：')), chr(10))"
_SAID = {
    "dataset": _LINES.format("'类型：数据集', '名称：doc-' || doc_id, '分类：' || coalesce(lang, ''), '部门：' || coalesce(source, ''), '可查询视图：reporting.vw_dataset_catalog'"),
    "table": _LINES.format("'类型：可查询视图', '名称：reporting.' || v, '字段：' || fields, 'DDL：CREATE VIEW reporting.' || v || ' (' || fields || ');'"),
    "field": _LINES.format("'类型：字段', '视图：reporting.' || v, '字段：' || field_name, '字段类型：' || field_type"),
    "metric": _LINES.format("'类型：指标', '名称：' || n_name, '指标编码：nation_' || n_nationkey, '别名：' || n_name || '、nation_' || n_nationkey, '领域：' || r_name, '单位：USD', '可查询视图：reporting.vw_value_yearly', '相关字段：region_name, stat_year, value_numeric, unit'"),
}


def _semantic_sources(spark, sf_dir):
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    metrics_ = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("indicator_name"), F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("indicator_code"), F.col("r_name").alias("domain"), F.lit("USD").alias("unit"), F.lit("reporting.vw_value_yearly").alias("view_name"))
    examples = spark.createDataFrame([("Value by year", "Order value of a region, year by year", ["trend"], None, "reporting.vw_value_yearly", "stat_year", "USD", "annual", "SELECT stat_year, value_numeric FROM reporting.vw_value_yearly ORDER BY stat_year")], semantic.NOTE)
    rules = spark.createDataFrame([("Units are said", "Values are given with their unit", ["unit"], "value_numeric and unit go together", "reporting", "unit", None, None, None)], semantic.NOTE)
    return reporting.dataset_catalog(spark, sf_dir), reporting.catalog(spark, sf_dir), metrics_, examples, rules


@query(f"""SELECT 'dataset' AS metadata_type, 'doc-' || doc_id AS name, 'reporting.vw_dataset_catalog' AS related_table, 'dataset_name' AS related_field, {_SAID["dataset"]} AS search_text FROM documents
  UNION ALL SELECT 'table', 'reporting.' || v, 'reporting.' || v, '', {_SAID["table"]} FROM (SELECT v, string_agg(field_name, ', ' ORDER BY field_name) AS fields FROM {_VIEW_FIELDS} GROUP BY v)
  UNION ALL SELECT 'field', 'reporting.' || v || '.' || field_name, 'reporting.' || v, field_name, {_SAID["field"]} FROM {_VIEW_FIELDS}
  UNION ALL SELECT 'metric', n_name, 'reporting.vw_value_yearly', 'value_numeric', {_SAID["metric"]} FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'sql_example', 'Value by year', 'reporting.vw_value_yearly', 'stat_year', array_to_string(['类型：sql_example', '名称：Value by year', '别名：trend', '说明：Order value of a region, year by year', '可查询视图：reporting.vw_value_yearly', '相关字段：stat_year', 'SQL示例：SELECT stat_year, value_numeric FROM reporting.vw_value_yearly ORDER BY stat_year'], chr(10))
  UNION ALL SELECT 'business_rule', 'Units are said', 'reporting', 'unit', array_to_string(['类型：business_rule', '名称：Units are said', '别名：unit', '说明：Values are given with their unit', '业务口径：value_numeric and unit go together', '可查询视图：reporting', '相关字段：unit'], chr(10))""")
def semantic_items(spark, sf_dir):
    datasets, views, metrics_, examples, rules = _semantic_sources(spark, sf_dir)
    return semantic.items(datasets, None, views, metrics_, examples, rules).select("metadata_type", "name", "related_table", "related_field", "search_text")


@query(f"""SELECT metadata_type, op, vector, count(*) AS n, CAST(count(*) FILTER (vector IS NOT NULL) AS BIGINT) AS embedded FROM (
  SELECT 'dataset' AS metadata_type, CASE WHEN d.lang IS NULL THEN 'created' WHEN l.toxic = 1 THEN 'updated' ELSE 'kept' END AS op, CASE WHEN d.lang IS NULL OR l.quality IS DISTINCT FROM 1 THEN 'new' WHEN l.toxic = 1 THEN 'replaced' ELSE 'reused' END AS vector
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
  UNION ALL SELECT 'table', 'created', NULL FROM {_VIEW_FIELDS} GROUP BY v UNION ALL SELECT 'field', 'created', NULL FROM {_VIEW_FIELDS} UNION ALL SELECT 'metric', 'created', 'new' FROM nation) WHERE metadata_type IN ('dataset', 'metric') GROUP BY ALL""")
def semantic_rebuild(spark, sf_dir):
    """Catalogue of the documents whose language is known, some with vectors, rebuilt for datasets and metrics once toxic documents are held back and the others come in."""
    datasets, views, metrics_, _, _ = _semantic_sources(spark, sf_dir)
    labels = load(spark, sf_dir, "labels").groupBy(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("dataset_name")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    judged = datasets.join(labels, "dataset_name", "left")
    before = semantic.items(judged.where("category is not null"), None, views.limit(0), metrics_.limit(0))
    good = judged.where("quality = 1").select(F.col("dataset_name").alias("name"))
    provider = embeddings.HashingProvider(16)
    vectors_ = embeddings.embed(before.join(good, "name", "left_semi"), provider, "item_id", "search_text")
    fresh = semantic.items(judged.withColumn("description", F.when(F.col("toxic") == 1, "held back")), None, views, metrics_)
    items, after = semantic.rebuild(before, vectors_, fresh, provider, ("dataset", "metric"))
    have = after.groupBy("item_id").agg(F.count(F.lit(1)).alias("vectors"))
    found = items.join(have, "item_id", "left").groupBy("metadata_type", F.col("_op").alias("op"), F.col("_vector").alias("vector"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("embedded"))


# Jobs, traces, evaluation

_JOBS = """(SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status, (event_id * 7 % 5)::BIGINT AS priority, ts AS created_at, (event_id % 4)::BIGINT AS retry_count, 2::BIGINT AS max_retries, ts AS heartbeat_at FROM events)"""


def _jobs(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("pending")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), (F.col("event_id") * 7 % 5).alias("priority"), F.col("ts").alias("created_at"), (F.col("event_id") % 4).alias("retry_count"), F.lit(2).cast("bigint").alias("max_retries"), F.col("ts").alias("heartbeat_at"))


@query(f"SELECT job_id, CASE WHEN status = 'running' AND retry_count < max_retries THEN 'pending' WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND retry_count < max_retries THEN retry_count + 1 ELSE retry_count END AS retry_count FROM {_JOBS}")
def job_transitions(spark, sf_dir):
    return jobs.failed(_jobs(spark, sf_dir), F.col("status") == "running").select("job_id", "status", "retry_count")


@query(f"SELECT job_id, priority FROM {_JOBS} WHERE status = 'pending' ORDER BY priority, created_at, job_id LIMIT 5")
def queue_next(spark, sf_dir):
    return jobs.next_jobs(_jobs(spark, sf_dir), 5).select("job_id", "priority")


@query(f"SELECT job_id FROM {_JOBS} WHERE status = 'running' AND heartbeat_at < TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 120 SECONDS")
def stuck_jobs(spark, sf_dir):
    return _jobs(spark, sf_dir).where(jobs.stuck(_jobs(spark, sf_dir), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))).select("job_id")


@query(f"SELECT job_id, CASE WHEN status = 'failed' THEN 'pending' WHEN status = 'pending' THEN 'cancelled' ELSE status END AS status FROM {_JOBS}")
def job_manual(spark, sf_dir):
    rows = _jobs(spark, sf_dir).withColumn("was", F.col("status"))
    return jobs.retried(jobs.cancelled(rows, F.col("was") == "pending"), F.col("was") == "failed").select("job_id", "status")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS span_order, count(*) OVER (PARTITION BY conv_id) + 1 AS next_order FROM conversations")
def trace_spans(spark, sf_dir):
    return jobs.spans(load(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", big("span_order"), big("next_order"))


_CASES = "(SELECT doc_id, quality, CASE WHEN (contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT) / 2.0 >= 0.5 THEN true ELSE false END AS keyword_ok, round((contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT) / 2.0, 4)::DOUBLE AS groundedness FROM documents JOIN labels USING (doc_id))"


@query(f"SELECT doc_id, groundedness, keyword_ok AND quality = 1 AS passed FROM {_CASES}")
def eval_score(spark, sf_dir):
    return evaluation.scored(_cases(spark, sf_dir)).select("doc_id", "groundedness", "passed")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE keyword_ok AND quality = 1) AS passed, round(count(*) FILTER (WHERE keyword_ok AND quality = 1)::DOUBLE / count(*), 4) AS pass_rate FROM {_CASES}")
def eval_pass_rate(spark, sf_dir):
    return evaluation.pass_rate(evaluation.scored(_cases(spark, sf_dir)))


def _cases(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.col("text").alias("answer"), F.array(F.lit("the"), F.lit("license")).alias("expected_keywords"), (F.col("quality") == 1).alias("route_ok"))


# Charts and citations


@query(f"SELECT region_name, CAST(max(CASE WHEN stat_year = 1995 THEN n_orders END) AS BIGINT) AS y1995, CAST(max(CASE WHEN stat_year = 1996 THEN n_orders END) AS BIGINT) AS y1996 FROM ({VALUE_YEARLY}) WHERE stat_year IN (1995, 1996) GROUP BY region_name")
def chart_pivot(spark, sf_dir):
    rows = reporting.value_yearly(spark, sf_dir).where("stat_year in (1995, 1996)").withColumn("series", F.concat(F.lit("y"), F.col("stat_year").cast("string")))
    # a cell's first row: here there is one
    return rows.groupBy("region_name").pivot("series", ["y1995", "y1996"]).agg(F.first("n_orders"))


@query(f"SELECT region_name, CASE WHEN count(DISTINCT nullif(unit, '')) = 1 THEN max(unit) ELSE '' END AS unit FROM ({VALUE_YEARLY}) GROUP BY region_name")
def unit_inference(spark, sf_dir):
    rows = reporting.value_yearly(spark, sf_dir)
    return rows.groupBy("region_name").agg(F.when(F.countDistinct(F.nullif("unit", F.lit(""))) == 1, F.max("unit")).otherwise("").alias("unit"))


@query("SELECT source AS title, min(doc_id) AS first_seen FROM documents GROUP BY source")
def data_sources(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("title")).agg(F.min("doc_id").alias("first_seen"))


@query("SELECT source, string_agg(DISTINCT lang, '；' ORDER BY lang) AS caveats FROM documents GROUP BY source")
def joined_caveats(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "；").alias("caveats"))


@query("SELECT label, median(embedding[1]::DOUBLE) AS middle, count(*) AS n FROM embeddings GROUP BY label")
def median_by_group(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.median(F.col("embedding")[0].cast("double")).alias("middle"), F.count(F.lit(1)).alias("n"))


# Events


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY ALL")
def ext_tumbling(spark, sf_dir):
    out = event_streams.tumbling(load(spark, sf_dir, "events"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def ext_session(spark, sf_dir):
    out = event_streams.sessions(load(spark, sf_dir, "events"))
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


# Rows that point at each other, and the parts of an answer


@query("SELECT l_orderkey * 10 + l_linenumber AS chunk_id, o_orderkey AS version_id, o_custkey AS document_id, c_nationkey AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def chunks_with_documents(spark, sf_dir):
    chunks = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("version_id"))
    versions = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"))
    documents = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("nation"))
    return linking.with_documents(chunks, versions, documents).select("chunk_id", "version_id", "document_id", "nation")


@query("SELECT vec_id AS chunk_id, doc_id AS document_id, source FROM embeddings JOIN documents ON vec_id = doc_id WHERE label = 3")
def vectors_with_documents(spark, sf_dir):
    held = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("hashing").alias("embedding_model"), F.col("label").cast("string").alias("embedding_version"), "embedding")
    docs = load(spark, sf_dir, "documents")
    chunks, versions = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("version_id")), docs.select(F.col("doc_id").alias("version_id"), F.col("doc_id").alias("document_id"))
    return linking.with_vectors(held, "hashing", "3", chunks, versions, docs.select(F.col("doc_id").alias("document_id"), "source")).select("chunk_id", "document_id", "source")


_TURNS = "(SELECT conv_id, turn, conv_id * 1000 + turn AS chunk_id, role, sha256(coalesce(text, '')) AS content_hash FROM conversations)"


@query(f"""SELECT conv_id, turn, chunk_id, reused, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM
  (SELECT f.conv_id, f.turn, coalesce(k.known, f.chunk_id) AS chunk_id, k.known IS NOT NULL AS reused FROM (SELECT * FROM {_TURNS} QUALIFY row_number() OVER (PARTITION BY conv_id, content_hash ORDER BY turn, chunk_id) = 1) f
  LEFT JOIN (SELECT conv_id, content_hash, min(chunk_id) + 500 AS known FROM {_TURNS} WHERE role = 'user' GROUP BY ALL) k ON f.conv_id = k.conv_id AND f.content_hash = k.content_hash) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, chunk_id)""")
def chunk_relink(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "role", "text")
    existing = turns.where("role = 'user'").withColumn("chunk_id", F.col("chunk_id") + 500)
    return linking.linked_chunks(existing, turns, "conv_id", "text", "turn").select("conv_id", "turn", "chunk_id", "reused", "previous_id", "next_id")


@query("SELECT a.conv_id, a.turn, b.conv_id * 1000 + b.turn AS parent_id FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn - 1 = b.turn")
def element_parents(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - 1).alias("parent_index"), (F.col("conv_id") * 1000 + F.col("turn")).alias("element_id"))
    return linking.with_parents(rows, "conv_id", "turn").select("conv_id", "turn", "parent_id")


@query("SELECT c_custkey AS view_id, c_mktsegment AS name, coalesce(o.fields, '') AS fields FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey, o_orderstatus) AS fields FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'")
def views_with_fields(spark, sf_dir):
    views = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("view_id"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "archived").otherwise("active").alias("status"))
    fields = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("view_id"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("field"))
    return linking.views_with_fields(views, fields, "view_id", "place", "field").select("view_id", "name", F.array_join("fields", ",").alias("fields"))


_CASE = "(SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'data' ELSE 'policy' END AS case_type, toxic = 0 AS enabled FROM labels)"


@query(f"SELECT case_id, case_type FROM {_CASE} WHERE enabled AND case_type IN ('data')")
def enabled_cases(spark, sf_dir):
    cases = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "data").otherwise("policy").alias("case_type"), (F.col("toxic") == 0).alias("enabled"))
    return linking.enabled_cases(cases, ("data",)).select("case_id", "case_type")


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS case_id, role AS case_type, trim(text) AS question FROM conversations), o AS (SELECT case_type, question, min(case_id) AS case_id, 'old' AS expected FROM c GROUP BY ALL),
  n AS (SELECT case_type, question, max(case_id) + 7 AS case_id, 'new' AS expected FROM c WHERE case_type = 'user' GROUP BY ALL UNION ALL SELECT 'extra', trim(text), max(item_id), 'new' FROM benchmark GROUP BY ALL)
  SELECT coalesce(o.case_type, n.case_type) AS case_type, coalesce(o.case_id, n.case_id) AS case_id, coalesce(n.expected, o.expected) AS expected, CASE WHEN n.case_id IS NULL THEN 'kept' WHEN o.case_id IS NULL THEN 'created' ELSE 'updated' END AS op
  FROM o FULL JOIN n ON o.case_type = n.case_type AND o.question = n.question""")
def upserted_cases(spark, sf_dir):
    asked = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.col("role").alias("case_type"), F.trim("text").alias("question"))
    old = asked.groupBy("case_type", "question").agg(F.min("case_id").alias("case_id")).withColumn("expected", F.lit("old"))
    more = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.lit("extra").alias("case_type"), F.col("text").alias("question"))
    new = asked.where("case_type = 'user'").withColumn("case_id", F.col("case_id") + 7).unionByName(more).withColumn("expected", F.lit("new"))
    return linking.upserted_cases(old, new).select("case_type", "case_id", "expected", F.col("_op").alias("op"))


_JOBS = "(SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'success' ELSE 'failed' END AS status, CAST(o_custkey % 1000 AS INT) AS priority, o_orderdate AS created_at FROM orders)"


def _job_rows(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    none = F.lit(None).cast("timestamp")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), (F.col("o_custkey") % 1000).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("locked_by"), none.alias("locked_at"), none.alias("heartbeat_at"), none.alias("started_at"))


@query(f"WITH j AS {_JOBS}, n AS (SELECT job_id FROM j WHERE status = 'pending' ORDER BY priority, created_at, job_id LIMIT 1) SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM n) THEN 'running' ELSE status END AS status, CASE WHEN job_id IN (SELECT job_id FROM n) THEN 'w1' END AS locked_by FROM j")
def job_lease(spark, sf_dir):
    return jobs.leased(_job_rows(spark, sf_dir), "w1", F.lit("2026-01-01").cast("timestamp")).select("job_id", "status", "locked_by")


@query(f"SELECT priority, '{{' || string_agg('\"' || status || '\":' || n, ',' ORDER BY status) || '}}' AS result FROM (SELECT priority, status, count(*) AS n FROM {_JOBS} GROUP BY ALL) GROUP BY priority")
def job_tallies(spark, sf_dir):
    return jobs.tallies(_job_rows(spark, sf_dir), "priority", "status")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_type ELSE p_name END AS query FROM part")
def topic_expansion(spark, sf_dir):
    topics = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit("  "), "p_type", "p_brand"))
    return load(spark, sf_dir, "part").select("p_partkey", answers.expanded_topics(topics, F.col("p_name")).alias("query"))


@query("""SELECT 'reporting.v' || n_nationkey AS full_name, min(c_custkey) AS first_rank, any_value(f.fields) AS fields FROM nation JOIN customer ON c_nationkey = n_nationkey
    JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS fields FROM supplier GROUP BY s_nationkey) f ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY n_nationkey""")
def candidate_views(spark, sf_dir):
    """Views named by hits (customers), of which some are not enabled, with their fields (suppliers)."""
    hits = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rank"), F.concat(F.lit(" reporting.v"), F.col("c_nationkey").cast("string")).alias("related_table"))
    views = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("view_id"), F.lit("reporting").alias("schema_name"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("view_name"), F.col("n_name").alias("description"), (F.col("n_regionkey") != 2).alias("enabled"))
    fields = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("view_id"), F.col("s_name").alias("field_name"))
    return generated.candidate_views(hits, views, fields).select("full_name", "first_rank", F.array_join("fields", ",").alias("fields"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderstatus || ',' ELSE '' END || CAST(o_custkey AS VARCHAR) AS cited FROM orders")
def merged_citations(spark, sf_dir):
    policy = F.when(F.col("o_orderstatus") == "O", F.array("o_orderstatus"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(answers.citations(policy, F.array(F.col("o_custkey").cast("string"))), ",").alias("cited"))


@query("SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, len(embedding) = 64 AS ok FROM embeddings")
def vector_norms(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", answers.vector_check(F.col("embedding"), 64).alias("c"))
    return rows.select("vec_id", big("c.dim").alias("dim"), F.round("c.norm", 5).alias("norm"), "c.ok")


@query("SELECT conv_id, turn, 'Instruct: find' || chr(10) || 'Query:' || text AS query FROM conversations")
def instructed_queries(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", answers.instructed(F.col("text"), " find ").alias("query"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def visible_traces(spark, sf_dir):
    return linking.visible(load(spark, sf_dir, "conversations").withColumnRenamed("role", "user_id"), "user").select("conv_id", "turn")


# Full text by an inverted index

POSTINGS = r"""
WITH words AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents WHERE doc_id IS NOT NULL),
postings AS (SELECT doc, len(w) AS length, t AS term, count(*) AS tf FROM (SELECT doc, w, unnest(w) AS t FROM words) GROUP BY ALL)"""
SEARCHED = "license and the"


def _index(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    index = fulltext.Index(spark, fresh_path(spark, "fulltext"), 16)
    index.add(load(spark, sf_dir, "documents"))
    return index


@query(POSTINGS + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM postings GROUP BY term")
def fulltext_frequencies(spark, sf_dir):
    """How many texts hold each term, as the index has it after two batches, the second of which brings some texts anew and all others again."""
    index = fulltext.Index(spark, fresh_path(spark, "fulltext"), 16)
    docs = load(spark, sf_dir, "documents")
    index.add(docs.withColumn("text", F.when(F.col("lang") == "en", F.upper(F.substring("text", 1, 50))).otherwise(F.col("text"))))
    index.add(docs)
    return index.frequencies()


@query(POSTINGS + f""",
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
asked AS (SELECT term, count(*) AS df FROM postings WHERE term IN ('{"', '".join(SEARCHED.split())}') GROUP BY term)
SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM postings JOIN asked USING (term), n GROUP BY doc HAVING count(*) = {len(SEARCHED.split())} ORDER BY score DESC, doc LIMIT 20""")
def fulltext_search(spark, sf_dir):
    return _index(spark, sf_dir).search(SEARCHED)


@query(POSTINGS + """
SELECT doc, CAST(count(*) AS INT) AS n FROM (SELECT doc, w, unnest(range(1, len(w))) AS i FROM words) WHERE w[i] = 'of' AND w[i + 1] = 'the' GROUP BY doc""")
def fulltext_phrase(spark, sf_dir):
    return _index(spark, sf_dir).phrase("of the")


# Page layout from boxes

CUT_PAGES = r"""
WITH cut AS (SELECT page_id, string_split_regex(html, '<[^>]*>') AS p FROM pages),
pieces AS (SELECT page_id, i, p[i + 1] AS text FROM (SELECT page_id, p, unnest(range(len(p))) AS i FROM cut)),
boxes AS (
  SELECT page_id, i, i // 30 AS page, text, 40.0 AS x0, 24.0 * (i % 30) AS y0, 40.0 + 5 * least(length(text), 100) AS x1, 24.0 * (i % 30) + 12 AS y1
  FROM pieces WHERE regexp_matches(text, '[^\s\x{0b}\p{Z}]'))"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The text between a page's tags as boxes, 30 to a leaf, and a table for every eleventh."""
    pages = load(spark, sf_dir, "pages")
    pieces = pages.select("page_id", F.posexplode(F.split("html", "<[^>]*>")).alias("i", "text")).where(F.col("text").rlike(r"[^\s\x{0b}\p{Z}]"))
    y = 24.0 * (F.col("i") % 30)
    size = F.when(F.length("text") % 7 == 0, 16.0).otherwise(12.0)
    boxes = pieces.select("page_id", "i", F.floor(F.col("i") / 30).alias("page"), "text", F.lit(40.0).alias("x0"), y.alias("y0"), (40.0 + 5 * F.least(F.length("text"), F.lit(100))).alias("x1"), (y + 12).alias("y1"), size.alias("size"))
    tables = boxes.where("i % 11 = 5").select("page_id", "page", F.lit("a | b").alias("text"), F.lit(60.0).alias("x0"), (F.col("y0") - 10).alias("y0"), F.lit(300.0).alias("x1"), (F.col("y0") + 30).alias("y1"))
    return boxes, tables, pages.select("page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"))


@query(CUT_PAGES + r""",
tables AS (SELECT page_id, page, 60.0 AS x0, y0 - 10 AS y0, 300.0 AS x1, y0 + 30 AS y1 FROM boxes WHERE i % 11 = 5),
held AS (
  SELECT DISTINCT b.page_id, b.i FROM boxes b JOIN tables t ON t.page_id = b.page_id AND t.page = b.page
  WHERE greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) > 0.2 * greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1)),
free AS (SELECT page_id, count(*) AS n FROM boxes ANTI JOIN held USING (page_id, i) WHERE NOT regexp_full_match(trim(text), '[-—_ ]*\d+[-—_ ]*') GROUP BY page_id),
drawn AS (SELECT page_id, count(*) AS n FROM tables GROUP BY page_id)
SELECT page_id, coalesce(free.n, 0) AS n_blocks, coalesce(drawn.n, 0) AS n_tables FROM free FULL JOIN drawn USING (page_id)""")
def layout_blocks(spark, sf_dir):
    """How many text blocks of each page lie in no table, as its elements have them joined, and its tables."""
    elements = layout.layout(*_boxes(spark, sf_dir), "page_id")
    return elements.where("not generated").groupBy("page_id").agg(F.sum("merged").alias("n_blocks"), F.count_if(F.col("merged") == 0).alias("n_tables"))


@query()
def page_layout(spark, sf_dir):
    return layout.layout(*_boxes(spark, sf_dir), "page_id").select("page_id", "order_index", "element_type", "content", "page_no", "heading_level", "parent_index", "merged", "generated")


# Queue and traces

TIMEOUT_S = 86_400
KINDS = "CASE WHEN floor(value) % 5 = 0 THEN 'retry' WHEN event_type = 'signup' THEN 'enqueue' WHEN event_type = 'view' THEN 'lease' WHEN event_type = 'click' THEN 'heartbeat' WHEN event_type = 'purchase' THEN 'success' ELSE 'failure' END"
_GONE = f"(s.status = 'running' AND e.ms - s.beat > {1000 * TIMEOUT_S})"
_STATUS = f"(CASE WHEN {_GONE} THEN CASE WHEN s.retries < 2 THEN 'pending' ELSE 'failed' END ELSE s.status END)"
_RETRIES = f"(s.retries + CASE WHEN {_GONE} AND s.retries < 2 THEN 1 ELSE 0 END)"


@query(f"""
WITH events_ AS (SELECT user_id AS job_id, event_id, epoch_ms(ts) AS ms, {KINDS} AS kind FROM events),
lists AS (SELECT job_id, list({{'kind': kind, 'ms': ms, 'status': 'none', 'retries': 0, 'beat': CAST(0 AS BIGINT)}} ORDER BY ms, event_id) AS l FROM events_ GROUP BY job_id),
folded AS (
  SELECT job_id, list_reduce(list_prepend({{'kind': '', 'ms': CAST(0 AS BIGINT), 'status': 'none', 'retries': 0, 'beat': CAST(0 AS BIGINT)}}, l), lambda s, e: {{
    'kind': e.kind, 'ms': e.ms,
    'status': CASE WHEN e.kind = 'enqueue' AND {_STATUS} = 'none' THEN 'pending' WHEN e.kind = 'lease' AND {_STATUS} = 'pending' THEN 'running' WHEN e.kind = 'success' AND {_STATUS} = 'running' THEN 'success'
      WHEN e.kind = 'failure' AND {_STATUS} = 'running' THEN CASE WHEN {_RETRIES} < 2 THEN 'pending' ELSE 'failed' END WHEN e.kind = 'retry' AND {_STATUS} = 'failed' THEN 'pending' ELSE {_STATUS} END,
    'retries': CASE WHEN e.kind = 'retry' AND {_STATUS} = 'failed' THEN 0 WHEN e.kind = 'failure' AND {_STATUS} = 'running' AND {_RETRIES} < 2 THEN {_RETRIES} + 1 ELSE {_RETRIES} END,
    'beat': CASE WHEN e.kind = 'lease' AND {_STATUS} = 'pending' OR e.kind = 'heartbeat' AND {_STATUS} = 'running' THEN e.ms ELSE s.beat END}}) AS s
  FROM lists)
SELECT job_id, s.status AS status, CAST(s.retries AS INT) AS retry_count FROM folded WHERE s.status <> 'none'""")
def job_states(spark, sf_dir):
    """Users as jobs, their events as the queue's."""
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("event_no"), F.col("ts").cast("timestamp").alias("ts"), F.expr(KINDS).alias("kind"), F.lit("w").alias("worker"), F.lit(None).cast("int").alias("max_retries"), F.lit(None).cast("int").alias("progress"), F.lit(None).cast("string").alias("error"))
    return worker.states(events, timeout_s=TIMEOUT_S).select("job_id", "status", "retry_count")


@query("""
WITH spans AS (SELECT user_id AS trace_id, event_id, event_type, greatest(CAST(floor(value) AS BIGINT), 0) AS ms, ts FROM events),
ends AS (SELECT trace_id, arg_max(event_type, event_id) AS status FROM spans GROUP BY trace_id)
SELECT trace_id, ends.status AS status, count(*) AS n_spans, CAST(sum(ms) AS BIGINT) AS span_ms, string_agg(event_type, ',' ORDER BY ts, event_id) AS path
FROM spans JOIN ends USING (trace_id) GROUP BY ALL""")
def trace_sink(spark, sf_dir):
    """Users as traces, their events as spans: all in one batch, the batch again, and the same spans in another batch."""
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("question", "route", "answer")]
    spans = events.select(F.col("user_id").alias("trace_id"), F.lit("span").alias("kind"), "ts", order.alias("span_order"), F.col("event_type").alias("span_type"), F.lit("success").alias("status"), F.floor("value").cast("long").alias("latency_ms"), "user_id", *nothing)
    ends = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("ts").alias("ts"))
    ends = ends.select(F.col("user_id").alias("trace_id"), F.lit("finish").alias("kind"), "ts", F.lit(None).cast("int").alias("span_order"), F.lit(None).cast("string").alias("span_type"), "status", F.lit(0).cast("long").alias("latency_ms"), "user_id", *nothing)
    sink = traces.TraceSink(spark, fresh_path(spark, "traces"))
    for batch in (0, 0, 1):
        sink.write(spans.unionByName(ends), batch)
    return sink.joined().select("trace_id", "status", "n_spans", "span_ms", F.array_join(F.transform("spans", lambda s: s["span_type"]), ",").alias("path"))


# Contracts of model outputs

_OUTPUT = """'{"route_type": ' || CASE WHEN event_id % 11 = 0 THEN 'null' WHEN event_id % 7 = 0 THEN '"ODD"' ELSE '"DATA_QA"' END || ', "needs_policy_evidence": true, "needs_data_analysis": '
  || CASE WHEN event_id % 5 = 0 THEN '"perhaps"' ELSE 'false' END || ', "confidence": ' || CASE WHEN event_id % 13 = 0 THEN '1.5' ELSE '0.5' END || ', "reason": "' || event_type || '"'
  || CASE WHEN event_id % 3 = 0 THEN ', "extracted_entities": {"metrics": ["a", 1], "normalized_time_range": {"start_year": "x"}}' ELSE '' END || CASE WHEN event_id % 17 = 0 THEN ']' ELSE '}' END"""


@query("""
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '$: no object' ELSE array_to_string(list_filter([
    CASE WHEN event_id % 11 = 0 THEN '$.route_type: missing' WHEN event_id % 7 = 0 THEN '$.route_type: no such option' END, CASE WHEN event_id % 5 = 0 THEN '$.needs_data_analysis: no truth value' END,
    CASE WHEN event_id % 13 = 0 THEN '$.confidence: not from 0 to 1' END, CASE WHEN event_id % 3 = 0 THEN '$.extracted_entities.normalized_time_range.start_year: no whole number' END,
    CASE WHEN event_id % 3 = 0 THEN '$.extracted_entities.metrics: not all texts' END], lambda x: x IS NOT NULL), '; ') END AS broken
FROM events""")
def contract_violations(spark, sf_dir):
    """Events as a model's outputs, some of them broken in several ways."""
    outputs = load(spark, sf_dir, "events").select("event_id", F.expr(_OUTPUT).alias("output"))
    return outputs.select("event_id", F.array_join(contracts.violations(F.col("output"), "QuestionRoute"), "; ").alias("broken"))


# Evaluation by all rules

_RULES = """
SELECT doc_id, label, quality, toxic, CASE WHEN n_chars % 4 = 0 THEN 'safety' WHEN n_chars % 4 = 1 THEN 'sql' ELSE 'rag' END AS case_type, CASE WHEN toxic = 1 THEN 'OTHER' WHEN n_chars % 4 = 1 THEN 'DATA_QA' ELSE 'POLICY_QA' END AS route,
  text, source, lang, CASE WHEN n_chars % 4 = 1 OR quality = 1 THEN 'SELECT n FROM reporting.vw_' || lang END AS sql FROM (SELECT *, 'x' AS label FROM documents JOIN labels USING (doc_id))"""


@query(f"""
WITH r AS ({_RULES}),
j AS (SELECT doc_id, case_type, CASE case_type WHEN 'safety' THEN 'OTHER' WHEN 'sql' THEN 'DATA_QA' ELSE 'POLICY_QA' END = route AS route_ok,
    round(((contains(lower(text || chr(10) || source || chr(10) || coalesce(sql, '')), 'license'))::INT + (contains(lower(text || chr(10) || source || chr(10) || coalesce(sql, '')), 'src1'))::INT) / 2, 4) AS keyword_score,
    contains(source, 'src1')::INT::DOUBLE AS citation_score, case_type <> 'sql' OR contains(coalesce(sql, ''), 'reporting.vw_en') AS view_ok, case_type <> 'sql' OR regexp_matches(coalesce(sql, ''), 'vw_(en|de)$') AS pattern_ok,
    coalesce(sql, '') <> '' AS sql_valid, case_type <> 'safety' OR route = 'OTHER' OR sql IS NULL AS safety_ok FROM r)
SELECT doc_id, route_ok, keyword_score, citation_score, view_ok, pattern_ok, sql_valid, safety_ok, route_ok AND keyword_score >= 0.5 AND citation_score > 0 AND view_ok AND pattern_ok AND safety_ok AS passed FROM j""")
def eval_rules(spark, sf_dir):
    """Labelled documents as responses, their sources as what they cite."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    kind = F.when(F.col("n_chars") % 4 == 0, "safety").when(F.col("n_chars") % 4 == 1, "sql").otherwise("rag")
    route = F.when(F.col("toxic") == 1, "OTHER").when(F.col("n_chars") % 4 == 1, "DATA_QA").otherwise("POLICY_QA")
    types = F.create_map(*[F.lit(x) for pair in evaluation.ROUTES.items() for x in pair])
    rows = rows.select(
        "doc_id", kind.alias("case_type"), types[kind].alias("expected_route_type"), route.alias("route"), F.col("text").alias("answer"), F.array(F.lit("License"), F.lit("SRC1")).alias("expected_keywords"), F.array(F.lit("Src1")).alias("expected_sources"),
        F.array(F.struct(F.col("source").alias("title"), F.lit("").alias("quote"), F.lit("").alias("section"))).alias("citations"), F.when(kind == "sql", "reporting.vw_en").alias("expected_view"), F.when(kind == "sql", "VW_(en|de)$").alias("expected_sql_pattern"),
        F.when((F.col("n_chars") % 4 == 1) | (F.col("quality") == 1), F.concat(F.lit("SELECT n FROM reporting.vw_"), "lang")).alias("sql"), F.lit(None).cast("string").alias("preview"), F.lit(None).cast("string").alias("chart"),
    )
    return evaluation.judged(rows).select("doc_id", "route_ok", "keyword_score", "citation_score", "view_ok", "pattern_ok", "sql_valid", "safety_ok", "passed")


# Tables in versions


@query("""SELECT CAST(number AS BIGINT) AS number, number = 3 AS current, CAST(times * len(embedding) AS BIGINT) AS dims, count(*) AS n_rows, CAST(sum(vec_id) AS BIGINT) AS ids
  FROM embeddings, (VALUES (1, 1), (2, 2), (3, 1)) v(number, times) GROUP BY ALL""")
def versioned_swap(spark, sf_dir):
    """Vectors, a version of twice their width in their place, and back: what each pointer names."""
    vectors_ = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    table = versions.VersionedTable(spark, fresh_path(spark, "versions"))
    table.write(vectors_)
    table.write(table.read().withColumn("embedding", F.concat("embedding", "embedding")))
    last = table.rollback()
    held = [table.read(n).withColumn("number", F.lit(n).cast("bigint")) for n, _ in table.history()]
    every = held[0].unionByName(held[1]).unionByName(held[2])
    return every.groupBy("number", (F.col("number") == last).alias("current"), F.array_size("embedding").cast("bigint").alias("dims")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("vec_id").alias("ids"))


# The order of arrival


@query("""SELECT user_id, event_id AS last_event, first_event, n FROM (SELECT *, first_value(event_id) OVER (PARTITION BY user_id ORDER BY place) AS first_event, count(*) OVER (PARTITION BY user_id) AS n
  FROM (SELECT *, row_number() OVER () AS place FROM events)) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place DESC) = 1""")
def arrival_winners(spark, sf_dir):
    """Each user's first and last event as the rows stand in the file."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    # dealt anew: the place in the file goes with the row
    return rows.repartition("event_id").groupBy("user_id").agg(F.max_by("event_id", "at").alias("last_event"), F.min_by("event_id", "at").alias("first_event"), F.count(F.lit(1)).alias("n"))


_SAID_TURNS = "(SELECT conv_id, turn, role, sha256(text) AS content_hash FROM conversations WHERE text IS NOT NULL)"


@query(f"""SELECT conv_id, turn, content_hash, 'v' || (coalesce(h.have, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn, content_hash)) AS version_no
  FROM (SELECT * FROM {_SAID_TURNS} t QUALIFY row_number() OVER (PARTITION BY conv_id, content_hash ORDER BY turn, role) = 1) f
  LEFT JOIN (SELECT conv_id, count(*) AS have FROM (SELECT DISTINCT conv_id, content_hash FROM {_SAID_TURNS} WHERE role = 'user') GROUP BY conv_id) h USING (conv_id)
  WHERE NOT EXISTS (SELECT 1 FROM {_SAID_TURNS} u WHERE u.role = 'user' AND u.conv_id = f.conv_id AND u.content_hash = f.content_hash)""")
def version_numbers(spark, sf_dir):
    """A conversation's texts as versions of it, numbered by turn after what users said."""
    turns = load(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("document_id"), "turn", "role", F.col("text").alias("clean_text"))
    have = turns.where("role = 'user'").select("document_id", F.sha2(F.col("clean_text").cast("binary"), 256).alias("content_hash")).distinct()
    return documents.numbered_versions(have, turns, "turn").select(F.col("document_id").alias("conv_id"), "turn", "content_hash", "version_no")


# Uploads


@query("""SELECT upload_id, first_value(upload_id) OVER w AS file_id, row_number() OVER w > 1 AS reused FROM (
  SELECT 0 AS batch, 'd' || doc_id AS upload_id, text AS content FROM documents UNION ALL SELECT 1, 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT 2, 'p' || page_id, html FROM pages)
  WHERE content IS NOT NULL WINDOW w AS (PARTITION BY content ORDER BY batch, upload_id)""")
def upload_dedupe(spark, sf_dir):
    """Documents, turns and pages as three batches of uploads, the second one replayed: which file each of them got."""
    store = uploads.UploadStore(spark, fresh_path(spark, "uploads"))
    name = lambda letter, *ids: F.concat(F.lit(letter), F.concat_ws("-", *ids))
    given = [(0, "documents", name("d", "doc_id"), "text"), (1, "conversations", name("c", "conv_id", "turn"), "text"), (1, "conversations", name("c", "conv_id", "turn"), "text"), (2, "pages", name("p", "page_id"), "html")]
    for batch, table, upload_id, content in given:
        store.write(load(spark, sf_dir, table).select(upload_id.alias("upload_id"), F.lit(None).cast("timestamp").alias("ts"), F.col(content).alias("content")), batch)
    return store.answers().select("upload_id", "file_id", "reused")
