"""Rules on questions: safety, time range, policy level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_query

# What a question must hold for each rule, the codes of the rules and their categories.
INTERNAL = ("数据库", "库里", "库内", "系统里", "系统内", "后台", "数据表", "表里", "表中", "表结构", "schema", "information_schema", "内部存储")
ENUMERATION = ("多少条", "几条", "有多少", "记录数", "记录数量", "行数", "数据量", "多少数据", "有哪些表", "哪些表", "列出表", "列出字段", "字段列表", "列名", "枚举", "count(", "count *", "count*")
PERSONAL = ("身份证", "手机号", "电话号码", "家庭住址", "个人住址", "个人轨迹", "人员名单", "姓名列表", "个人信息明细", "用户密码", "所有用户")
SECRET = ("api key", "apikey", "access token", "密钥", "密码", "连接串", "database_url", "jwt_secret", "系统prompt", "系统 prompt", "系统提示词", ".env", "环境变量")
DISCLOSURE = ("查询", "列出", "导出", "给我", "显示", "查看", "返回", "获取", "告诉我", "读取", "打印", "是什么", "当前值")
MUTATION = ("删除", "修改", "更新", "写入", "插入", "执行sql", "执行 sql", "drop ", "delete ", "update ", "insert ", "alter ")
RAW_SQL = r"\b(select|delete|update|insert|drop|alter|create)\b[\s\S]*\b(from|table|view|into)\b"
CATEGORIES = {"EMPTY_QUESTION": "invalid_input", "INTERNAL_ASSET_ENUMERATION": "internal_metadata", "PERSONAL_DATA_REQUEST": "personal_data", "SECRET_OR_CONFIG_REQUEST": "credentials", "DATABASE_MUTATION_REQUEST": "database_operation", "RAW_DATABASE_STATEMENT": "database_operation", "ALLOW": "allowed"}
# Words that name a policy level, the first that applies, and the year range of a question.
LEVELS = (("national", ("国家", "全国", "国家级")), ("province", ("省", "自治区")), ("city", ("市", "北京", "上海", "广州", "深圳")), ("district", ("区", "县")))
NUMERALS = "一二三四五六七八九十"


def _any(q: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [q.contains(w) for w in words])


def security_decision(question: Column) -> Column:
    """The code of the first rule that applies; ALLOW if none does."""
    q = normalize_query(question)
    return (
        F.when(question.isNull() | (q == ""), "EMPTY_QUESTION")
        .when(_any(q, INTERNAL) & _any(q, ENUMERATION), "INTERNAL_ASSET_ENUMERATION")
        .when(_any(q, PERSONAL) & _any(q, DISCLOSURE), "PERSONAL_DATA_REQUEST")
        .when(_any(q, SECRET) & _any(q, DISCLOSURE), "SECRET_OR_CONFIG_REQUEST")
        .when(_any(q, INTERNAL) & _any(q, MUTATION), "DATABASE_MUTATION_REQUEST")
        .when(q.rlike(RAW_SQL), "RAW_DATABASE_STATEMENT")
        .otherwise("ALLOW")
    )


def security_category(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[code]


def policy_level(question: Column) -> Column:
    out = F
    for level, words in LEVELS:
        out = out.when(_any(question, words), level)
    return out


def time_range(question: Column, year: int) -> Column:
    """struct(start_year, end_year, confidence) of the years a question names; null where it names none. Recent years include this one."""
    none = F.lit(None).cast("struct<start_year:int,end_year:int,confidence:double>")
    part = lambda pattern, i: F.regexp_extract(question, pattern, i)
    made = lambda a, b, c: F.struct(a.cast("int").alias("start_year"), b.cast("int").alias("end_year"), F.lit(c).cast("double").alias("confidence"))
    both = r"(20\d\d)\s*年?\s*(?:到|至|~|-|—)\s*(20\d\d)"
    digits, word = r"(?:近|最近)\s*(\d{1,2})\s*年", rf"(?:近|最近)\s*([{NUMERALS}两])\s*年"
    count = F.when(part(word, 1) == "两", 2).otherwise(F.instr(F.lit(NUMERALS), part(word, 1)))
    now = F.lit(year)
    a, b = part(both, 1), part(both, 2)
    return (
        F.when(question.rlike(both), made(F.least(a, b), F.greatest(a, b), 0.95))
        .when(question.rlike(digits), made(now - F.nullif(part(digits, 1), F.lit("")).cast("int") + 1, now, 0.85))
        .when(question.rlike(word), made(now - count + 1, now, 0.85))
        .when(question.contains("去年"), made(now - 1, now - 1, 0.9))
        .when(question.contains("今年"), made(now, now, 0.9))
        .when(question.rlike(r"(20\d\d)\s*年"), made(part(r"(20\d\d)\s*年", 1), part(r"(20\d\d)\s*年", 1), 0.9))
        .otherwise(none)
    )
