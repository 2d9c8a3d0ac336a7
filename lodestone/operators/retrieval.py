"""Hybrid retrieval: dense, keyword and token candidates, merged and ranked.

One query meets the corpus: its vector and terms are literals, so nothing is broadcast and the
corpus is scanned once a branch; every branch ends in a top-k, which Spark keeps per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_query, once, query_text, terms_of, tokens_of
from ..functions.vectors import cosine
from .fulltext import Index

# Weights of dense, keyword, token match and exact match.
POLICY = (0.62, 0.22, 0.08, 0.25)
SEMANTIC = (0.68, 0.18, 0.08, 0.24)


def dense(rows: DataFrame, vector: list[float], id_col: str, vector_col: str, k: int = 20) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = rows.select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("dense_score"))
    return scored.orderBy(F.desc("dense_score"), id_col).limit(k)


def prefiltered(rows: DataFrame, query: str, weights: dict[str, int], id_col: str, k: int = 20, terms: int = 16) -> DataFrame:
    """The best rows by summed weights: the query counts 20, each term 1, times the column's weight; clamp(10 k, 100, 500) of them."""
    words = terms_of(query)[:terms]

    def points(column: str) -> Column:
        held = lambda low: sum((low.contains(t).cast("int") for t in words), 20 * low.contains(query.lower()).cast("int"))
        return once(F.lower(F.coalesce(F.col(column), F.lit(""))), held)

    parts = [w * points(c) for c, w in weights.items()]
    rank: Column = sum(parts[1:], parts[0])
    return rows.withColumn("prefilter_rank", rank).where("prefilter_rank > 0").orderBy(F.desc("prefilter_rank"), id_col).limit(min(500, max(100, 10 * k)))


def keyword(rows: DataFrame, query: str, text: Column, id_col: str, k: int = 20) -> DataFrame:
    terms, whole = terms_of(query), query_text(query)
    if not terms:
        return rows.select(id_col, F.lit(0.0).alias("keyword_score"), F.lit(0.0).alias("exact_score")).where(F.lit(False))
    # both scores from one normalised text
    number = lambda x: F.when(x, 1.0).otherwise(0.0)
    score = lambda low: F.struct(F.round(sum((number(low.contains(t)) for t in terms), F.lit(0.0)) / len(terms), 6).alias("k"), number(low.contains(whole)).alias("e"))
    scored = rows.select(id_col, once(normalize_query(text), score).alias("s")).select(id_col, F.coalesce("s.k", F.lit(0.0)).alias("keyword_score"), F.coalesce("s.e", F.lit(0.0)).alias("exact_score"))
    return scored.where((F.col("keyword_score") > 0) | (F.col("exact_score") > 0)).orderBy(F.desc("exact_score"), F.desc("keyword_score"), id_col).limit(k)


def tokens(rows: DataFrame, query: str, text: Column, id_col: str, k: int = 20) -> DataFrame:
    """Rows that hold every token, by how often the query's tokens come per thousand characters (our own measure)."""
    words = tokens_of(query)
    if not words:
        return rows.select(id_col, F.lit(0.0).alias("token_score")).where(F.lit(False))
    asked = F.array(*[F.lit(w) for w in words])
    # most texts lack one of the words as a string already, and are never cut into tokens
    possible = reduce(lambda a, b: a & b, [F.lower(text).contains(w) for w in words])
    found = rows.where(possible).select(id_col, F.length(text).alias("size"), F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w]+)"), 1), lambda t: F.array_contains(asked, t)).alias("found"))
    scored = found.where(F.size(F.array_distinct("found")) == len(words)).select(id_col, F.round(F.least(F.lit(1.0), F.size("found") * 10.0 / F.greatest("size", F.lit(1))), 6).alias("token_score"))
    return scored.orderBy(F.desc("token_score"), id_col).limit(k)


def indexed(index: Index, rows: DataFrame, query: str, id_col: str, k: int = 20) -> DataFrame:
    """Like `tokens`, from the index: BM25 s as s / (1 + s). rows: those that a search may see; their texts aren't read."""
    found = index.search(query, None).select(F.col("doc").alias(id_col), F.round(F.col("score") / (1 + F.col("score")), 6).alias("token_score"))
    return found.join(rows.select(id_col), id_col, "left_semi").orderBy(F.desc("token_score"), id_col).limit(k)


def merged(branches: dict[str, DataFrame], id_col: str) -> DataFrame:
    """One row an id: the largest of each score (0 if none), `sources` in the order of the branches, and the place it was first seen."""
    scores = ["dense_score", "keyword_score", "exact_score", "token_score"]
    out = None
    for i, (name, rows) in enumerate(branches.items()):
        place = F.row_number().over(Window.orderBy(*[F.desc(c) for c in scores if c in rows.columns], id_col))  # at most k rows
        rows = rows.withColumn("seen", F.struct(F.lit(i).alias("branch"), place.alias("place"), F.lit(name).alias("name")))
        rows = rows.withColumns({c: F.lit(0.0) for c in scores if c not in rows.columns}).drop("place")
        out = rows if out is None else out.unionByName(rows)
    merged_ = out.groupBy(id_col).agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in scores], F.array_sort(F.collect_set("seen")).alias("seen"))
    return merged_.select(id_col, *scores, F.array_join(F.array_distinct(F.transform("seen", lambda s: s["name"])), ",").alias("sources"), F.col("seen")[0].alias("first_seen"))


def final_score(weights: tuple[float, float, float, float], more: Column | float = 0.0) -> Column:
    d, k, t, e = weights
    bonus = more if isinstance(more, Column) else F.lit(more)
    return F.round(d * F.col("dense_score") + k * F.col("keyword_score") + t * F.col("token_score") + e * F.col("exact_score") + bonus, 6)


def metadata_score(validity: Column, status: Column, level: Column, wanted: str | None, levels: tuple[str, ...] = ()) -> Column:
    """Bonuses of policy documents: valid, of unknown validity, published, of a level that the filter names, of the level asked for."""
    out = F.when(validity == "active", 0.08).when(validity == "unknown", 0.03).otherwise(0.0) + F.when(status == "published", 0.04).otherwise(0.0)
    out = out + F.when(level.isin(*levels), 0.05).otherwise(0.0) if levels else out
    return out + F.when(level == wanted, 0.06).otherwise(0.0) if wanted else out


def reranked(rows: DataFrame, group: str, k: int = 8, per_group: int = 2) -> DataFrame:
    """The k best by final_score, ties by first_seen, at most per_group of one document."""
    order = [F.desc("final_score"), F.asc("first_seen")]
    capped = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= per_group).drop("_n")
    return capped.orderBy(*order).limit(k)


def policy_filter(rows: DataFrame, published_only: bool = True, validity: tuple[str, ...] = ("active", "unknown"), levels: tuple[str, ...] = (), since: str | None = None, until: str | None = None, effective_since: str | None = None, effective_until: str | None = None) -> DataFrame:
    """The chunks a search may see; a row without a date fails a filter of that date."""
    if published_only:
        rows = rows.where("publish_status = 'published'")
    if validity:
        rows = rows.where(F.col("validity_status").isin(*validity))
    if levels:
        rows = rows.where(F.col("policy_level").isin(*levels))
    for column, low, high in (("publish_date", since, until), ("effective_date", effective_since, effective_until)):
        if low:
            rows = rows.where(F.col(column) >= F.lit(low).cast("date"))
        if high:
            rows = rows.where(F.col(column) <= F.lit(high).cast("date"))
    return rows


def retrieve(chunks: DataFrame, embeddings: DataFrame, query: str, vector: list[float], model: str, version: str, level: str | None = None, k: int = 8, index: Index | None = None, **filters) -> DataFrame:
    """The k best chunks (chunk_id, document_id, retrieval_text, title, document_no, policy_level, validity_status, publish_status, publish_date) of a query, with scores and sources.

    index: the chunks' inverted index, for full text without reading the texts. filters: see `policy_filter`.
    """
    base = policy_filter(chunks, **filters)
    text = F.concat_ws("\n", "retrieval_text", "title", "document_no")
    vectors = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_version") == version)).join(base.select("chunk_id"), "chunk_id")
    words = prefiltered(base, query, {"retrieval_text": 1, "title": 2, "document_no": 3}, "chunk_id")
    branches = {"dense": dense(vectors, vector, "chunk_id", "embedding"), "keyword": keyword(words, query, text, "chunk_id"), "fulltext": indexed(index, base, query, "chunk_id") if index else tokens(base, query, text, "chunk_id")}
    found = merged(branches, "chunk_id").join(base, "chunk_id")
    bonus = metadata_score(F.col("validity_status"), F.col("publish_status"), F.col("policy_level"), level, tuple(filters.get("levels", ())))
    return reranked(found.withColumn("final_score", final_score(POLICY, bonus)), "document_id", k)


def context(hits: DataFrame, blocks: int = 8) -> DataFrame:
    """rank, block: the evidence text of the best hits."""
    top = hits.orderBy(F.desc("final_score"), F.asc("first_seen")).limit(blocks)
    rank = F.row_number().over(Window.orderBy(F.desc("final_score"), F.asc("first_seen")))  # at most `blocks` rows
    return top.withColumn("rank", rank).select("rank", F.format_string("资料%d\n%s\n%s", "rank", F.coalesce("title", F.lit("")), "retrieval_text").alias("block"))
