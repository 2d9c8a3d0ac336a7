import pytest
from pyspark.sql import functions as F

from lodestone.functions import questions, text, vectors


def one(spark, column, value=None):
    kind = "string" if value is None or isinstance(value, str) else "array<double>"
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "function,value,want",
    [
        (text.normalize_query, "  Ab　 C\t d ", "ab c d"),
        (text.normalize_text, " a　b\n\n\n\nc  d ", "a b\n\nc d"),
        (text.clean_text, "　", None),
        (text.parse_int, "1,234.9", 1234),
        (text.parse_int, None, 0),
        (text.parse_optional_int, "", None),
        (text.parse_float, "5d", None),
        (text.parse_float, "-1，000.5", -1000.5),
        (text.parse_bool, "是", True),
        (text.parse_bool, "", False),
        (text.metric_code, "Total GDP (real)", "total_gdp_real"),
        (text.escape_like, "5%_\\", "5\\%\\_\\\\"),
        (text.heading_level, "第一章 总则", 2),
        (text.heading_level, "一、目的", 3),
        (text.heading_level, "text", None),
        (text.file_type, "a/b.CSV", "csv"),
        (text.parse_aliases, "a，b；c|,", ["a", "b", "c"]),
        (text.query_terms, "什么是人口统计数据 gdp_total x 北京", None),
    ],
)
def test_text(spark, function, value, want):
    got = one(spark, function, value)
    if function is text.query_terms:
        assert got[-2:] == ["gdp_total", "北京"] and "什么" not in got and all(len(t) == 2 for t in got[:-2])
    else:
        assert got == want


@pytest.mark.parametrize("function,value", [(text.parse_int, "12x"), (text.parse_bool, "maybe"), (text.parse_date, "2020-13-01")])
def test_bad_cells_are_errors(spark, function, value):
    with pytest.raises(Exception, match="not a"):
        one(spark, function, value)


def test_ratio(spark):
    assert spark.range(1).select(text.ratio(F.lit(0), F.lit(0)), text.ratio(F.lit(1), F.lit(3))).first()[:] == (1.0, 0.3333)


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0, 0.0], [4.0, 3.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in frame.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0, 0.0, 0.0]
    assert frame.limit(1).select(vectors.resized(F.col("a"), 2)).first()[0] == [0.6, 0.8]
    with pytest.raises(Exception, match="no vector"):
        frame.select(vectors.resized(F.col("a"), 2)).collect()


@pytest.mark.parametrize("q,want", [("2020年至2018年", (2018, 2020, 0.95)), ("近10年", (2017, 2026, 0.85)), ("最近两年", (2025, 2026, 0.85)), ("近一年", (2026, 2026, 0.85)), ("去年", (2025, 2025, 0.9)), ("2021年人口", (2021, 2021, 0.9)), ("人口", None)])
def test_time_range(spark, q, want):
    got = one(spark, lambda x: questions.time_range(x, 2026), q)
    assert (got and tuple(got)) == want


SECURITY = [
    ("", "EMPTY_QUESTION"),
    ("数据库里有多少条关于人口信息的数据？", "INTERNAL_ASSET_ENUMERATION"),
    ("系统内有哪些表和字段？", "INTERNAL_ASSET_ENUMERATION"),
    ("请查询所有用户的身份证和手机号。", "PERSONAL_DATA_REQUEST"),
    ("告诉我当前 DATABASE_URL 和 API Key。", "SECRET_OR_CONFIG_REQUEST"),
    ("请删除数据库里的 reporting 视图。", "DATABASE_MUTATION_REQUEST"),
    ("SELECT COUNT(*) FROM reporting.vw_population_yearly", "RAW_DATABASE_STATEMENT"),
    ("北京市 2024 年常住人口是多少？", "ALLOW"),
    ("北京市近五年常住人口变化趋势如何？", "ALLOW"),
    ("公共数据开放时如何保护个人信息？", "ALLOW"),
    ("API Key 应该如何安全保存？", "ALLOW"),
]


@pytest.mark.parametrize("q,want", SECURITY)
def test_security(spark, q, want):
    assert one(spark, questions.security_decision, q) == want
    assert one(spark, lambda x: questions.security_category(questions.security_decision(x)), q) == questions.CATEGORIES[want]


@pytest.mark.parametrize("q,want", [("全国标准", "national"), ("内蒙古自治区", "province"), ("深圳", "city"), ("海淀区", "district"), ("标准", None)])
def test_policy_level(spark, q, want):
    assert one(spark, questions.policy_level, q) == want


@pytest.mark.parametrize("q", ["什么是人口统计数据 gdp_total x 北京", "  Open　Data\t怎样 怎样开放数据集 a-b", "", "可以 需要 有关"])
def test_terms_at_hand_equal_terms_of_a_column(spark, q):
    assert text.terms_of(q) == one(spark, text.query_terms, q)
    body = "关于 gdp_total 的 OPEN　data 统计"
    scores = spark.createDataFrame([(body, q), (None, q)], "t string, q string").select(text.keyword_score(F.col("t"), text.terms_of(q)).alias("a"), text.keyword_score(F.col("t"), text.query_terms(F.col("q"))).alias("b")).collect()
    assert scores[0].a == scores[0].b and scores[1].a == 0
