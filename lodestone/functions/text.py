"""Text columns: normalisation, coercion of cells, query terms and keyword scores."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question words and connectives that are no search terms.
STOP_TERMS = ("什么", "哪些", "如何", "怎么", "怎样", "是否", "可以", "需要", "关于", "有关")
CJK = r"\x{4e00}-\x{9fff}"


def trimmed(x: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_query(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def normalize_text(x: Column | str) -> Column:
    """Ideographic blanks become blanks, runs of blanks one, three or more line ends two."""
    flat = F.regexp_replace(F.regexp_replace(x, "　", " "), r"[ \t\f\x{0b}]+", " ")
    return trimmed(F.regexp_replace(flat, r"\n{3,}", "\n\n"))


def normalize_label(x: Column) -> Column:
    return F.regexp_replace(trimmed(x), r"(?U)\s+", " ")


def clean_text(x: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(trimmed(x), F.lit(""))


def parse_float(x: Column) -> Column:
    """Thousands separators dropped; what is no plain decimal number is null."""
    bare = F.regexp_replace(trimmed(x), "[,，]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.cast("double"))


def parse_int(x: Column) -> Column:
    """Null and empty are 0, decimals are cut off, anything else is an error."""
    number = parse_float(x)
    bad = F.raise_error(F.concat(F.lit("not a number: "), x)).cast("bigint")
    return F.when(clean_text(x).isNull(), F.lit(0).cast("bigint")).when(number.isNull(), bad).otherwise(number.cast("bigint"))


def parse_optional_int(x: Column) -> Column:
    return F.when(clean_text(x).isNotNull(), parse_int(x))


def parse_bool(x: Column) -> Column:
    word = F.lower(trimmed(F.coalesce(x, F.lit(""))))
    return F.when(word.isin("true", "1", "yes", "y", "是"), True).when(word.isin("false", "0", "no", "n", "否", ""), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), x)).cast("boolean"))


def parse_date(x: Column) -> Column:
    """The first ten characters as an ISO date; null stays null, anything else is an error."""
    day = F.try_to_date(F.substring(trimmed(x), 1, 10), "yyyy-MM-dd")
    return F.when(clean_text(x).isNull(), F.lit(None).cast("date")).when(day.isNull(), F.raise_error(F.concat(F.lit("not a date: "), x)).cast("date")).otherwise(day)


def parse_aliases(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[,，;；、|]"), trimmed), lambda a: a != "")


def metric_code(name: Column) -> Column:
    """A code for a metric without one: its letters and digits, or a digest of its name."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(trimmed(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain != "", plain).otherwise(F.concat(F.lit("metric_"), F.substring(F.sha1(name.cast("binary")), 1, 10)))


def enum_or(x: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    value = F.lower(trimmed(x))
    return F.when(value.isin(*allowed), value).otherwise(fallback)


def escape_like(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def query_terms(query: Column, cap: int = 64) -> Column:
    """Words of two or more ASCII letters, digits, '_' or '-', and runs of ideographs: up to four whole, longer ones as bigrams. In order, once each, without stop terms."""
    tokens = F.regexp_extract_all(normalize_query(query), F.lit(f"([a-z0-9_-]{{2,}}|[{CJK}]{{2,}})"), 1)
    stops = F.array(*[F.lit(s) for s in STOP_TERMS])
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    terms = F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(f"^[{CJK}]{{5,}}$"), pairs(t)).otherwise(F.array(t))))
    return F.slice(F.array_distinct(F.filter(terms, lambda t: ~F.array_contains(stops, t))), 1, cap)


def query_text(query: str) -> str:
    """`normalize_query` of a query at hand."""
    return " ".join(query.split()).lower()


def terms_of(query: str, cap: int = 64) -> list[str]:
    """`query_terms` of a query at hand, so that plans hold its terms as constants."""
    out = []
    for token in re.findall("[a-z0-9_-]{2,}|[\u4e00-\u9fff]{2,}", query_text(query)):
        long = len(token) > 4 and token[0] >= "\u4e00"
        out += [token[i : i + 2] for i in range(len(token) - 1)] if long else [token]
    return [t for t in dict.fromkeys(out) if t not in STOP_TERMS][:cap]


def tokens_of(query: str) -> list[str]:
    """The words of a query at hand, lower-cased, once each."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x worked out once a row however often `use` names it."""
    return F.transform(F.array(x), use)[0]


def keyword_score(text: Column, terms: Column | list[str]) -> Column:
    """Share of the terms that the text holds."""
    if isinstance(terms, list):
        held = lambda low: reduce(lambda a, b: a + b, [F.when(low.contains(t), 1.0).otherwise(0.0) for t in terms], F.lit(0.0)) / max(len(terms), 1)
        return F.coalesce(once(normalize_query(text), held), F.lit(0.0))
    return once(normalize_query(text), lambda low: F.size(F.filter(terms, lambda t: F.instr(low, t) > 0)) / F.greatest(F.size(terms), F.lit(1)))


def exact_score(text: Column, query: Column | str) -> Column:
    if isinstance(query, str):
        q = query_text(query)
        return F.when(normalize_query(text).contains(q), 1.0).otherwise(0.0) if q else F.lit(0.0)
    q = normalize_query(query)
    return F.when((q != "") & (F.instr(normalize_query(text), q) > 0), 1.0).otherwise(0.0)


def all_tokens(text: Column, query: Column) -> Column:
    """Whether every token of the query is a token of the text."""
    tokens = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)([\w]+)"), 1))
    return (F.size(tokens(query)) > 0) & (F.size(F.array_except(tokens(query), tokens(text))) == 0)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def token_count(text: Column) -> Column:
    return F.greatest(F.length(text), F.lit(1))


def preview(text: Column, size: int = 1000) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def ratio(hits: Column, total: Column) -> Column:
    """Nothing to find counts as found; four places, halves to even."""
    return F.when(total <= 0, 1.0).otherwise(F.bround(hits / F.greatest(total, F.lit(1)), 4))


def heading_level(text: Column) -> Column:
    """Levels of numbered headings; null for text that is none."""
    t = trimmed(text)
    return F.when(F.length(t) > 80, None).when(t.rlike("^第[一二三四五六七八九十百千万0-9]+章"), 2).when(t.rlike("^第[一二三四五六七八九十百千万0-9]+节"), 3).when(t.rlike("^[一二三四五六七八九十]+、"), 3)


def file_type(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
