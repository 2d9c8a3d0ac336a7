import zlib
from collections import Counter

from lodestone.llm.stratified_shards import ORACLE, op12_stratified_shards, shards
from tests.oracle import given, wanted

from .fixtures import SCHEMA, SF, docs, empty, rows


def taken(df):
    return [r.asDict() for r in df.collect()]


def test_equals_its_oracle(spark):
    assert given(op12_stratified_shards(spark, SF)) == wanted(ORACLE, SF)


def test_counts_mixture_and_slots(spark):
    table = rows(60) + [(1000 + i, f"hot {i % 3}", None, "hot", None, None, None, None, None) for i in range(400)] + [(7, "again", None, "hot", None, None, None, None, None)] * 30
    out = taken(shards(spark.createDataFrame(table, SCHEMA), 6, part_rows=16))
    n, sources = len(out), Counter(r[3] or "" for r in table)
    assert n == len(table)
    assert Counter((r["doc_id"], r["source"], r["size"], r["text_crc32"]) for r in out) == Counter((r[0], r[3] or "", len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in table)
    held = Counter(r["shard"] for r in out)
    assert set(held) == set(range(6)) and max(held.values()) - min(held.values()) <= 1
    for shard, m in held.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(m))
        mixed = Counter(r["source"] for r in out if r["shard"] == shard)
        for source, k in sources.items():
            assert abs(mixed[source] - m * k / n) <= 1 + len(sources) * k / n


def test_parts_and_bins_change_nothing(spark):
    small, large = (sorted(taken(shards(docs(spark), 5, part_rows=k)), key=str) for k in (3, 1 << 14))
    assert small == large


def test_seeds_order_anew_and_fewer_rows_than_shards(spark):
    one, two = ({r["doc_id"]: r["slot"] for r in taken(shards(docs(spark), 2, seed=s))} for s in (1, 2))
    assert one != two
    few = taken(shards(docs(spark).limit(3), 24))
    assert len(few) == 3 and all(r["slot"] == 0 for r in few)


def test_empty_table(spark):
    assert taken(shards(empty(spark))) == []
