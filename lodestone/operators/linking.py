"""Rows that point at each other: chunks, their versions and documents, elements and their parents, views and their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_documents(chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their version's and document's columns; chunks that lack either are left out."""
    return chunks.join(versions, "version_id").join(documents, "document_id")


def with_vectors(embeddings: DataFrame, model: str, version: str, chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """The vectors of one model and version, which are picked before they meet anything, with all that stands around their chunks."""
    picked = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_version") == version))
    return with_documents(picked.join(chunks, "chunk_id"), versions, documents)


def linked_chunks(existing: DataFrame, fresh: DataFrame, version: str, content: str, order: str, chunk: str = "chunk_id") -> DataFrame:
    """version, chunk id, content hash, order, reused, previous and next chunk: a version's chunks, each content once (the first by order).

    A content that the version has already keeps its chunk's id (the smallest); the others take the id they bring.
    """
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash")
    known = existing.select(version, digest, F.col(chunk).alias("known")).groupBy(version, "content_hash").agg(F.min("known").alias("known"))
    rows = fresh.select(version, digest, order, chunk).groupBy(version, "content_hash").agg(F.min(F.struct(order, chunk)).alias("first")).select(version, "content_hash", "first.*")
    rows = rows.join(known, [version, "content_hash"], "left").select(version, F.coalesce("known", chunk).alias(chunk), "content_hash", order, F.col("known").isNotNull().alias("reused"))
    line = Window.partitionBy(version).orderBy(order, chunk)
    return rows.withColumns({"previous_id": F.lag(chunk).over(line), "next_id": F.lead(chunk).over(line)})


def with_parents(elements: DataFrame, version: str, order: str = "order_index", parent: str = "parent_index", element: str = "element_id") -> DataFrame:
    """Elements with parent_id: the element of the same version that stands at their parent index."""
    heads = elements.select(F.col(version), F.col(order).alias(parent), F.col(element).alias("parent_id"))
    return elements.join(heads, [version, parent], "left")


def views_with_fields(views: DataFrame, fields: DataFrame, view: str, order: str, field: str) -> DataFrame:
    """Active views, each with the list of its fields in order; a view without fields has an empty one."""
    listed = fields.groupBy(view).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, field))), lambda f: f[field]).alias("fields"))
    return views.where("status = 'active'").join(listed, view, "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))


def enabled_cases(cases: DataFrame, types: tuple[str, ...] = (), ids: tuple[int, ...] = ()) -> DataFrame:
    """Enabled evaluation cases, of some types or ids only where these are given."""
    out = cases.where("enabled")
    out = out.where(F.col("case_type").isin(*types)) if types else out
    return out.where(F.col("case_id").isin(*ids)) if ids else out


def upserted_cases(cases: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cases by (case_type, trimmed question): a fresh one takes the place of the one before and keeps its id; of fresh ones with one key the largest id counts."""
    key = ["case_type", "question"]
    trimmed = fresh.withColumn("question", F.trim("question"))
    rest = [c for c in cases.columns if c not in key]
    one = trimmed.groupBy(*key).agg(F.max(F.struct("case_id", *[c for c in rest if c != "case_id"])).alias("new"))
    both = cases.join(one, key, "full")
    has = F.col("new").isNotNull()
    columns = [F.coalesce("case_id", "new.case_id").alias("case_id") if c == "case_id" else F.when(has, F.col("new").getField(c)).otherwise(F.col(c)).alias(c) for c in rest]
    status = F.when(~has, "kept").when(F.col("case_id").isNull(), "created").otherwise("updated").alias("_op")
    return both.select(*key, *columns, status)


def case_results(runs: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """A run's results with their cases; results whose case is gone are kept."""
    return runs.join(results, "run_id").join(cases, "case_id", "left")


def visible(traces: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """All traces for an administrator, else the user's own."""
    return traces if admin else traces.where(F.col("user_id") == user)


def hit_projection(hits: DataFrame) -> DataFrame:
    """What a trace keeps of hits: ids, scores and sources, never vectors or texts."""
    kept = [c for c in ("chunk_id", "document_id", "item_id", "dense_score", "keyword_score", "exact_score", "token_score", "final_score", "sources") if c in hits.columns]
    return hits.select(*kept)
