"""How filters share the work of removing documents: a Walsh-Hadamard audit of all their orders.

Each document has a mask, one bit for each filter that it fails. By part and label the documents are
summed 32 times with signs, (-1)^|mask and S| for every set S of the five filters; the Walsh-Hadamard
transform of those sums, over 32, gives back exactly how many documents have each mask. Orders need
no other pass: what a sequence of filters keeps are the masks that share no bit with it, and over all
120 orders a document that fails k filters is removed by each of them 120/k times, which is the
Shapley count.

The rows are first collapsed: the mask follows from the text but for "same text as a smaller id", so
rows of one text (by SHA-256), part and label become one row with a count before anything else moves.
A group of copies, however large, is combined where it is read, and texts are never shuffled.

Defined cases: a null text is the empty text, and equal to it; a null part is ''; a row without an id
is a copy of none, has no copies and no labels; rows of one id and text are copies of none of themselves;
several labels of one id count as good or toxic if any of them says so; a document without words has no
repeated ones; an empty table gives no rows. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep, load

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
COPY = SETS >> 1  # the bit of E
ORDERS = 120


def with_mask(rows: DataFrame) -> DataFrame:
    """rows with `mask` in place of `text`: bits 0 to 3 stand for the filters A to D that the text fails."""
    # only the first and the last piece can be empty
    cut = rows.withColumn("w", F.split("text", "[\\x20\\x09-\\x0D]+"))
    first, last = F.col("w")[0] == "", F.element_at("w", -1) == ""
    n = F.size("w") - first.cast("int") - (last & (F.size("w") > 1)).cast("int")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    counted = cut.select("*", n.alias("n_words"), (F.size(F.array_distinct("w")) - (first | last).cast("int")).alias("n_distinct"), capitals.cast("long").alias("n_capitals"))
    fails = [F.col("n_words") < 50, 100 * F.col("n_distinct") < 65 * F.col("n_words"), 100 * F.col("n_capitals") > 5 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    return counted.select(*[c for c in rows.columns if c != "text"], sum((x.cast("int") * (1 << i) for i, x in enumerate(fails)), F.lit(0)).alias("mask"))


def sign(a: int | Column, b: int | Column) -> Column:
    """-1 where the masks share an odd number of bits, else 1."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    return F.when(F.bit_count(a.bitwiseAND(b)) % 2 == 0, 1).otherwise(-1)


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, good, toxic, mask, n: how many documents of a text have them (several rows where texts differ)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("same"), text.alias("text"))
    # rows that say the same, first where they are read
    rows = with_mask(rows).groupBy("id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    told = rows.join(marks, "id", "left").select("id", "part", "same", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = told.groupBy("same", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(named).alias("first"))
    # an id can stand in several rows of a group: those were one row before, so `first` has all of them
    least = F.min(F.col("first.id")).over(Window.partitionBy("same"))
    alone = F.col("unnamed") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    parted = groups.withColumn("alone", alone)
    kinds = F.array(F.struct(F.col("mask"), F.col("alone").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))
    return parted.select("part", "good", "toxic", F.explode(kinds).alias("k")).select("part", "good", "toxic", "k.mask", "k.n").where("n > 0")


def parity_sums(cells: DataFrame) -> DataFrame:
    """part, good, toxic, sums: the 32 signed sums."""
    found = cells.groupBy("part", "good", "toxic").agg(*[F.sum(sign(F.col("mask"), s) * F.col("n")).alias(f"s{s}") for s in range(SETS)])
    return found.select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(SETS)]).alias("sums"))


def inverted(sums: DataFrame) -> DataFrame:
    """part, good, toxic, cells: how many documents have each mask, from their parity sums."""
    at = lambda m: F.aggregate(F.zip_with("sums", F.sequence(F.lit(0), F.lit(SETS - 1)), lambda v, s: v * sign(m, s)), F.lit(0).cast("long"), lambda a, x: a + x)
    return sums.select("part", "good", "toxic", F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda m: F.shiftright(at(m), len(FILTERS))).alias("cells"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step. columns: id_col, text_col, part_col, where docs has other names than those of `masked`."""
    sums = keep(parity_sums(masked(docs, labels, **columns)))
    return evaluated(inverted(sums))


def evaluated(cells: DataFrame) -> DataFrame:
    """Every order and step over the mask cells of each part."""
    masks = F.sequence(F.lit(0), F.lit(SETS - 1))
    total = lambda chosen: F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + x)
    # a part has four kinds of labels at most
    kinds = cells.groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "cells")).alias("kinds"))
    none = F.array_repeat(F.lit(0).cast("long"), SETS)
    added = lambda chosen: F.aggregate(chosen, none, lambda a, x: F.zip_with(a, x["cells"], lambda u, v: u + v))
    parts = kinds.select("part", added(F.col("kinds")).alias("cells"), added(F.filter("kinds", lambda x: x["good"] == 1)).alias("good"), added(F.filter("kinds", lambda x: x["toxic"] == 1)).alias("toxic"))
    # what every set of filters, whatever the order within, leaves over
    left = lambda name: F.transform(masks, lambda s: total(F.filter(F.col(name), lambda _, m: m.bitwiseAND(s) == 0)))
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    share = lambda bit: total(F.transform(F.col("cells"), lambda n, m: F.when(m.bitwiseAND(bit) != 0, n * F.floor(F.lit(ORDERS) / F.bit_count(m))).otherwise(0).cast("long")))
    parts = parts.select("part", left("cells").alias("kept"), left("good").alias("good"), left("toxic").alias("toxic"), F.transform(bits, lambda b: F.get("cells", b)).alias("only"), F.transform(bits, share).alias("shapley"))
    steps = [{"o": "".join(o), "k": k + 1, "f": FILTERS.index(o[k]), "b": sum(1 << FILTERS.index(x) for x in o[:k])} for o in permutations(FILTERS) for k in range(len(FILTERS))]
    steps = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,k:int,f:int,b:int>>"))
    rows = parts.select("*", steps.alias("x")).select("*", "x.*").withColumn("own", F.pow(F.lit(2), F.col("f")).cast("int")).withColumn("after", F.col("b") + F.col("own"))
    lost = lambda kind: F.col(kind)[F.col("b")] - F.col(kind)[F.col("after")]
    failing = F.col("kept")[0] - F.col("kept")[F.col("own")]
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("k").alias("step"), F.col("kept")[F.col("after")].alias("kept"), lost("kept").alias("removed"), (failing - lost("kept")).alias("redundant"),
        F.col("only")[F.col("f")].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shapley")[F.col("f")].alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


# each document's failures one by one, and every order played through
ORACLE = r"""
with recursive marks as (
    select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
texts as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
worded as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') w, min(doc_id) over (partition by t) first from texts),
docs as (
    select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
        {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
         'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first < worded.doc_id, false)} f
    from worded left join marks on marks.doc_id = worded.doc_id),
fails as (
    select part, good, toxic, (case when f.A then 'A' else '' end) || (case when f.B then 'B' else '' end) || (case when f.C then 'C' else '' end)
        || (case when f.D then 'D' else '' end) || (case when f.E then 'E' else '' end) f, count(*) n
    from docs group by all),
orders(o) as (
    select '' union all select o || l from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) l) where not contains(o, l)),
steps as (
    select o, k, o[k] x, o[1:k - 1] before from orders, (select unnest(range(1, 6))::int k) where length(o) = 5),
played as (
    select part, o filter_order, k step, x, n, good, toxic, f, contains(f, x) failing,
        len(list_filter(string_split(f, ''), lambda c: c <> '' and contains(before, c))) > 0 gone
    from steps, fails),
counted as (
    select part, filter_order, step, x,
        coalesce(sum(n) filter (not gone and not failing), 0) kept, coalesce(sum(n) filter (not gone and failing), 0) removed,
        coalesce(sum(n) filter (gone and failing), 0) redundant, coalesce(sum(n) filter (f = x), 0) unique_fails,
        coalesce(sum(n) filter (not gone and failing and good = 1), 0) good_lost, coalesce(sum(n) filter (not gone and failing and toxic = 1), 0) toxic_lost
    from played group by all)
select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
    good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, x))::bigint shapley
from counted
"""
