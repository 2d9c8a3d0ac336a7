"""What a language model's JSON must look like, as columns: outputs are parsed once to a variant, and every rule they break is named.

Fields that no contract knows are passed over. Numbers and truth values may be written as strings,
texts may not be written as numbers. `answered` asks a provider again for outputs that break rules,
with the rules and the output in the prompt, a bounded number of times; each round is written to
the shared folder, as a provider may answer otherwise when asked anew.

Defined cases: null, blank and broken outputs break the rule "$: no object", and so do arrays and
bare values; a null counts as missing only where a field must be given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, written


@dataclass(frozen=True)
class Field:
    """kind: text, flag, whole, share (0 to 1), texts, object or objects (of the contract `of`). given: must be there. open: may be null."""

    kind: str
    given: bool = False
    open: bool = False
    options: tuple[str, ...] = ()
    of: str = ""
    filled: bool = False


MUST, MAY = {"given": True}, {"open": True}
# The contracts' fields, options and bounds.
CONTRACTS: dict[str, dict[str, Field]] = {
    "NormalizedTimeRange": {"start_year": Field("whole", **MAY), "end_year": Field("whole", **MAY), "grain": Field("text", options=("year", "month", "day"), **MAY), "source_text": Field("text", **MAY), "confidence": Field("share")},
    "ExtractedEntities": {"region": Field("text", **MAY), "time_range": Field("text", **MAY), "normalized_time_range": Field("object", of="NormalizedTimeRange", **MAY), "metrics": Field("texts"), "policy_topics": Field("texts")},
    "QuestionRoute": {"route_type": Field("text", options=("POLICY_QA", "DATA_QA", "HYBRID_QA", "OTHER"), **MUST), "needs_policy_evidence": Field("flag", **MUST), "needs_data_analysis": Field("flag", **MUST), "confidence": Field("share", **MUST), "reason": Field("text", **MUST), "extracted_entities": Field("object", of="ExtractedEntities")},
    "PolicyCitation": {"source_id": Field("text", **MUST), "source_title": Field("text", **MUST), "source_url": Field("text", **MAY), "section_path": Field("text", **MAY), "quote": Field("text", **MUST)},
    "RagAnswer": {"answer": Field("text", **MUST), "evidence_sufficient": Field("flag", **MUST), "citations": Field("objects", of="PolicyCitation"), "caveat": Field("text", **MAY), "suggested_followups": Field("texts")},
    "SqlGenerationResult": {"sql": Field("text", filled=True, **MUST), "reason": Field("text", **MUST), "used_metadata_ids": Field("texts"), "confidence": Field("share", **MUST)},
    "DataSourceCitation": {"title": Field("text", **MUST), "source_url": Field("text", **MAY)},
    "SqlResultExplanation": {"summary": Field("text", **MUST), "key_findings": Field("texts"), "data_sources": Field("objects", of="DataSourceCitation"), "caveat": Field("text", **MAY)},
    "ChartSpec": {"chart_type": Field("text", options=("line", "bar", "pie", "table"), **MUST), "x_field": Field("text", **MAY), "y_field": Field("text", **MAY), "series_field": Field("text", **MAY), "title": Field("text", **MUST), "reason": Field("text", **MUST)},
    "HybridPolicyCitation": {"source_title": Field("text", **MUST), "source_url": Field("text", **MAY), "section_path": Field("text", **MAY), "quote": Field("text", **MUST)},
    "HybridAnswer": {"answer": Field("text", **MUST), "policy_citations": Field("objects", of="HybridPolicyCitation"), "data_sources": Field("objects", of="DataSourceCitation"), "used_sql": Field("flag", **MUST), "used_policy_evidence": Field("flag", **MUST), "caveat": Field("text", **MAY)},
}
FLAGS = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")


def _rules(v: Column, name: str, path: Column) -> Column:
    """Array of the rules that an object breaks."""
    found = []
    for field, rule in CONTRACTS[name].items():
        part = F.try_variant_get(v, f"$.{field}", "variant")
        kind, at = F.schema_of_variant(part), F.concat(path, F.lit(f".{field}"))
        text = F.try_variant_get(v, f"$.{field}", "string")
        number = F.when(kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "STRING"), text.try_cast("double"))
        said = lambda what, at=at: F.concat(at, F.lit(f": {what}"))
        broken: Column
        more = None
        if rule.kind == "text":
            broken = F.when(kind != "STRING", said("no text"))
            if rule.options:
                broken = broken.when(~text.isin(*rule.options), said("no such option"))
            if rule.filled:
                broken = broken.when(F.trim(text) == "", said("empty"))
        elif rule.kind == "flag":
            broken = F.when(~((kind == "BOOLEAN") | (kind.isin("BIGINT", "STRING") & F.lower(text).isin(*FLAGS))), said("no truth value"))
        elif rule.kind == "whole":
            broken = F.when(number.isNull() | (number != F.floor(number)), said("no whole number"))
        elif rule.kind == "share":
            broken = F.when(number.isNull(), said("no number")).when(~number.between(0, 1), said("not from 0 to 1"))
        elif rule.kind == "texts":
            broken = F.when(~kind.startswith("ARRAY<"), said("no list")).when(~kind.isin("ARRAY<STRING>", "ARRAY<VOID>") | F.exists(F.try_variant_get(v, f"$.{field}", "array<string>"), lambda x: x.isNull()), said("not all texts"))
        elif rule.kind == "object":
            broken = F.when(~kind.startswith("OBJECT<"), said("no object"))
            more = F.when(kind.startswith("OBJECT<"), _rules(part, rule.of, at))
        else:
            broken = F.when(~kind.startswith("ARRAY<"), said("no list"))
            items = F.try_variant_get(v, f"$.{field}", "array<variant>")
            each = lambda item, i, of=rule.of, at=at: F.when(F.schema_of_variant(item).startswith("OBJECT<"), _rules(item, of, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))).otherwise(F.array(F.concat(at, F.lit("["), i.cast("string"), F.lit("]: no object"))))
            more = F.when(kind.startswith("ARRAY<"), F.flatten(_each(items, each)))
        missing = F.when(kind.isNull() | (kind == "VOID"), said("missing")) if rule.given and not rule.open else F.when(kind == "VOID", F.lit(None) if rule.open else said("null"))
        one = F.when(kind.isNull() | (kind == "VOID"), missing).otherwise(broken)
        found.append(F.array_compact(F.array(one)))
        if more is not None:
            found.append(F.coalesce(more, F.array().cast("array<string>")))
    return F.concat(*found)


def _each(items: Column, rule: Callable[[Column, Column], Column]) -> Column:
    return F.transform(items, lambda item, i: rule(item, i))


def violations(output: Column, name: str) -> Column:
    """The rules of a contract that an output breaks, in the order of its fields; none for a good one."""
    if name not in CONTRACTS:
        raise ValueError(f"unknown contract {name}")
    v = F.try_parse_json(output)
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))
    return F.when(~good, F.array(F.lit("$: no object"))).otherwise(_rules(v, name, F.lit("$")))


def parsed(output: Column, schema: str) -> Column:
    """A good output as a struct."""
    return F.from_json(output, schema)


def known_ids(used: Column, allowed: Column) -> Column:
    """struct of valid (those of `used` that are allowed, in order) and unknown (the others)."""
    return F.struct(F.filter(used, lambda x: F.array_contains(allowed, x)).alias("valid"), F.filter(used, lambda x: ~F.array_contains(allowed, x)).alias("unknown"))


PREVIEW = 500


def feedback(prompt: Column, output: Column, broken: Column) -> Column:
    """The prompt again, with what was wrong."""
    held = F.trim(F.coalesce(output, F.lit("")))
    short = F.when(F.length(held) > PREVIEW, F.concat(F.substring(held, 1, PREVIEW), F.lit("...[truncated]"))).otherwise(held)
    return F.concat(prompt, F.lit("\n\nThe last output broke these rules. Give one JSON object only.\n"), F.array_join(broken, "\n"), F.lit("\nThe last output was: "), short)


def answered(prompts: DataFrame, provider: Callable[[list[str]], list[str | None]], name: str, retries: int = 1) -> DataFrame:
    """id, output, violations, retry_count for each (id, prompt): the first good output, or the last one after `retries` more tries.

    provider answers a batch of prompts; it runs in tasks.
    """
    if retries < 0:
        raise ValueError("retries must not be negative")
    spark, kind = prompts.sparkSession, prompts.schema["id"].dataType.simpleString()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(output=provider(frame["prompt"].tolist()))

    done, left = None, prompts.select("id", "prompt")
    for n in range(retries + 1):
        out = left.mapInPandas(ask, f"id {kind}, prompt string, output string").withColumn("violations", violations(F.col("output"), name))
        out = written(out, fresh_path(spark, "answers"))
        ends = out if n == retries else out.where(F.size("violations") == 0)
        ends = ends.select("id", "output", "violations", F.lit(n).alias("retry_count"))
        done = ends if done is None else done.unionByName(ends)
        left = out.where(F.size("violations") > 0).select("id", feedback(F.col("prompt"), F.col("output"), F.col("violations")).alias("prompt"))
        if n == retries or left.isEmpty():
            break
    return done
