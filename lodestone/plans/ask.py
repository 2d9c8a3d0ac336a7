"""A question from its safety check to its answer's evidence. What a language model decides comes from a provider."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.questions import policy_level, security_decision, time_range
from . import guard


@dataclass
class Answer:
    status: str
    route: str
    decision: str
    years: tuple[int, int] | None = None
    sql: str | None = None
    result: dict | None = None
    evidence: list[str] = field(default_factory=list)
    caveats: list[str] = field(default_factory=list)
    spans: list[tuple[str, str, int]] = field(default_factory=list)


def chart_kind(columns: list[str], rows: int) -> str:
    """Line for a series over years, bar for one category, else a table."""
    years = [c for c in columns if "year" in c or "date" in c]
    return "table" if rows < 2 or len(columns) < 2 else "line" if years else "bar" if len(columns) == 2 else "table"


def ask(spark: SparkSession, question: str, year: int, route: Callable[[str], str], write_sql: Callable[[str, tuple[int, int] | None], str], evidence: Callable[[str, str | None], list[str]]) -> Answer:
    """route says data, policy, hybrid or other; write_sql and evidence do what their names say. Refused questions reach neither."""
    row = spark.range(1).select(security_decision(F.lit(question)).alias("d"), time_range(F.lit(question), year).alias("t"), policy_level(F.lit(question)).alias("l")).first()
    if row["d"] != "ALLOW":
        return Answer("refused", "OTHER", row["d"])
    out = Answer("success", route(question), "ALLOW", (row["t"]["start_year"], row["t"]["end_year"]) if row["t"] else None)

    def step(name: str, work: Callable[[], None]) -> None:
        start, status = time.monotonic(), "success"
        try:
            work()
        except Exception as e:
            status, out.status = "failed", "failed"
            out.caveats.append(f"{name}: {type(e).__name__}")
        out.spans.append((name, status, int((time.monotonic() - start) * 1000)))

    def data() -> None:
        out.sql = write_sql(question, out.years)
        out.result = guard.execute(spark, guard.validate(spark, out.sql))
        out.result["chart"] = chart_kind(out.result["columns"], out.result["row_count"])

    if out.route in ("data", "hybrid"):
        step("sql", data)
    if out.route in ("policy", "hybrid"):
        step("retrieval", lambda: out.evidence.extend(evidence(question, row["l"])))
    out.caveats = list(dict.fromkeys(out.caveats))
    return out
