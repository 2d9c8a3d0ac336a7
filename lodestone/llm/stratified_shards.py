"""Shards that each match the mixture of sources: proportional stratified interleaving, in DataFrame functions alone.

Within each source rows are ranked in seeded random order. The row of rank r (from 0) of a source
of n rows stands at the fraction (2r + 1) / 2n; all rows are sorted by fraction, and the sorted
sequence is cut into shards whose counts differ by one at most. Every stretch of the sequence
then holds each source by its share, so a shard of m rows has of a source with share w no more
than 1 + w * (number of sources) away from m * w.

No task sees a whole source or the whole sequence. A source's rows are ranked in parts by the
leading bits of their hash, and the sequence in bins by fraction; both have about `part_rows` rows
however the sources are sized (in a bin each source has its share), and the starts of parts and
bins are running sums over counts, a `part_rows`-th of the rows. Texts are read once, for their
length and checksum, and never shuffled.

Defined cases: a null source counts as the source ''; a null text has no bytes (size 8, checksum 0);
rows without an id and rows of one id are ordered by checksum and size, and rows equal in those too
are interchangeable; equal texts are not held together, as a group may be larger than a shard;
with fewer rows than shards some shards stay empty; an empty table gives no rows. Other columns of
the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep, load

SEED = 17
PART_ROWS = 1 << 14
HEX = 7  # digits of the hash that place a row in a part


def _starts(cells: DataFrame, within: list[str], order: str) -> DataFrame:
    """cells (with a count n each) and `start`: how many rows the cells before hold; within: columns in which to sum apart."""
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, size, text_crc32 and the seeded hash that orders a source's rows."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return rows.withColumn("hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))))


def ranked(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """rows with `fraction`: where each stands in its source, from 0 to 1."""
    parts = max(1, rows.count() // part_rows)
    place = F.floor(F.conv(F.substring("hash", 1, HEX), 16, 10).cast("long") * parts / (1 << 4 * HEX))
    placed = rows.withColumn("part", place)
    cells = placed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    cells = _starts(cells, ["source"], "part").withColumn("of", F.sum("n").over(Window.partitionBy("source")))
    within = Window.partitionBy("source", "part").orderBy("hash", "doc_id", "size")
    out = placed.withColumn("rank", F.row_number().over(within) - 1).join(cells.drop("n"), ["source", "part"])
    return out.withColumn("fraction", (2 * (F.col("start") + F.col("rank")) + 1) / (2 * F.col("of"))).drop("start", "rank", "of", "part")


def sequenced(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """rows with `position` from 0 by fraction, sources of one fraction by name, and `rows`, their number."""
    n = rows.count()
    placed = rows.withColumn("bin", F.floor(F.col("fraction") * max(1, n // part_rows)))
    bins = _starts(placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), [], "bin")
    within = Window.partitionBy("bin").orderBy("fraction", "source", "hash", "doc_id", "size")
    out = placed.withColumn("at", F.row_number().over(within) - 1).join(bins.select("bin", "start"), "bin")
    return out.withColumn("position", F.col("start") + F.col("at")).withColumn("rows", F.lit(n).cast("long")).drop("bin", "at", "start")


def shards(docs: DataFrame, count: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard (from 0), slot (gapless from 0 in its shard)."""
    rows = keep(_measured(docs, id_col, text_col, source_col, seed))
    placed = sequenced(keep(ranked(rows, part_rows)), part_rows)
    placed = placed.withColumn("shard", F.expr(f"position * {count} div rows").cast("int"))
    first = F.expr(f"(shard * rows + {count - 1}) div {count}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("position") - first).alias("slot"))


def op12_stratified_shards(spark, sf_dir: str) -> DataFrame:
    out = shards(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# checksums by a table of 256 steps over the bytes of each text; ranks and positions by plain windows
ORACLE = f"""
with step as (
    select list(t order by i) t from (
        select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) t
        from (select unnest(range(256))::bigint i))),
measured as (
    select doc_id, coalesce(source, '') source, strlen(coalesce(text, '')) + 8 size,
        case when coalesce(text, '') = '' then 0 else xor(list_reduce(
            list_prepend(4294967295::bigint, string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '0x\\1 ', 'g')), ' ')::bigint[]),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) end text_crc32
    from documents, step),
hashed as (select *, md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || text_crc32) hash from measured),
ranked as (
    select *, (2 * (row_number() over (partition by source order by hash, doc_id, size) - 1) + 1)::double / (2 * count(*) over (partition by source)) fraction
    from hashed),
placed as (
    select *, row_number() over (order by fraction, source, hash, doc_id, size) - 1 as position, count(*) over () n from ranked)
select doc_id, size::bigint size, text_crc32::bigint text_crc32, 'rows' law, (position * 24 // n)::int shard,
    (position - ((position * 24 // n) * n + 23) // 24)::bigint slot, null::int grown_shard
from placed
"""
