"""What a language model needs to write a statement, and what its statement is checked for before the guard sees it."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAR = re.compile(r"(?i)\bselect\s+(?:distinct\s+)?(?:\w+\.)?\*")


def candidate_views(hits: DataFrame, views: DataFrame, fields: DataFrame, schema: str = "reporting") -> DataFrame:
    """full_name, first_rank, description, fields: the enabled views that hits (rank, related_table) name, with their fields in order of name.

    first_rank is the rank of the first hit that names the view. Names of other schemas, views that
    are not enabled and views without fields are left out. views: view_id, schema_name, view_name,
    description, enabled; fields: view_id, field_name.
    """
    name = F.trim("related_table")
    named = hits.where(name.startswith(f"{schema}.") & (F.size(F.split(name, r"\.")) == 2)).groupBy(name.alias("full_name")).agg(F.min("rank").alias("first_rank"))
    listed = fields.groupBy("view_id").agg(F.array_sort(F.collect_list("field_name")).alias("fields"))
    enabled = views.where("enabled").select("view_id", "description", F.concat_ws(".", "schema_name", "view_name").alias("full_name"))
    return enabled.join(named, "full_name").join(listed, "view_id").select("full_name", "first_rank", "description", "fields")


def problems(sql: str, views: Iterable[str], years: tuple[int | None, int | None] | None = None) -> list[str]:
    """What is wrong with a statement by its text: SELECT_STAR, NO_CANDIDATE_VIEW, and MISSING_YEAR for each year of the range that it doesn't hold."""
    found = ["SELECT_STAR"] if STAR.search(sql) else []
    if not any(v.lower() in sql.lower() for v in views):
        found.append("NO_CANDIDATE_VIEW")
    return found + [f"MISSING_YEAR {y}" for y in dict.fromkeys(years or ()) if y is not None and str(y) not in sql]
