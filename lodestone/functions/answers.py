"""Column rules on the parts of an answer: ranges, topics, citations, fields and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Policy topics and what they are also called.
TOPICS = {"公共数据开放": ("公共数据资源",), "个人信息保护": ("个人信息", "个人隐私"), "数据安全": ("分类分级",)}


def merged_range(inferred: Column, given: Column) -> Column:
    """The range that the question's own words say, else the one that came with the route."""
    return F.coalesce(inferred, given)


def expanded_topics(topics: Column, question: Column) -> Column:
    """Topics and their other names, in order and once each, as one text; without topics the question."""
    flat = F.filter(F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))), lambda t: t != "")
    more = lambda t: reduce(lambda a, b: F.concat(a, b), [F.when(t.contains(k), F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>")) for k, v in TOPICS.items()], F.array(t))
    text = F.array_join(F.array_distinct(F.flatten(F.transform(flat, more))), " ")
    return F.when(text != "", text).otherwise(question)


def citations(policy: Column, data: Column) -> Column:
    """Policy sources, then data sources; a missing list is empty."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(policy, none), F.coalesce(data, none))


def known_ids(named: Column, candidates: Column) -> Column:
    """Of the ids that an answer names, those among the candidates, in order and once each."""
    return F.filter(F.array_distinct(named), lambda x: F.array_contains(candidates, x))


def unknown_ids(named: Column, candidates: Column) -> Column:
    return F.array_except(named, candidates)


def field_type(kind: str) -> str:
    """boolean, number or text, from the name of a Spark type."""
    number = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return "boolean" if kind == "boolean" else "number" if kind.split("(")[0] in number else "text"


def instructed(query: Column, instruction: str | None) -> Column:
    """The query behind its instruction, as instructed embedding models want it."""
    told = (instruction or "").strip()
    return F.concat(F.lit(f"Instruct: {told}\nQuery:"), query) if told else query


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def vector_check(vector: Column, dim: int) -> Column:
    """struct(dim, norm, ok): whether a provider's vector has the length that is expected."""
    return F.struct(F.size(vector).alias("dim"), F.round(norm(vector), 6).alias("norm"), F.coalesce(F.size(vector) == dim, F.lit(False)).alias("ok"))


def number(x: Column) -> Column:
    """A chart's number; null for what is none or isn't finite."""
    value = x.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def quoted_identifier(name: str) -> str:
    """The name in quotes; only letters, digits and underscores may stand in it."""
    plain = name.strip()
    if not plain or not plain.replace("_", "").isalnum():
        raise ValueError(f"Invalid SQL identifier: {name}")
    return f'"{plain}"'
