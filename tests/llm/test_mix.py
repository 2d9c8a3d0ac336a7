from fractions import Fraction
from math import ceil, floor

from lodestone.llm import pfair_mix as pm
from tests.llm.fixtures import docs, empty


def brute(blocks, weights):
    """Slot by slot: of the released blocks the one due first, ties by source; a phase ends where a source has none left."""
    done, out = dict.fromkeys(blocks, 0), []
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        total = sum(Fraction(weights[s]) for s in left)
        w, had, t = {s: Fraction(weights[s]) / total for s in left}, dict.fromkeys(left, 0), 0
        while True:
            open_ = [(ceil((had[s] + 1) / w[s]), s) for s in left if floor(had[s] / w[s]) <= t]
            s = min(open_)[1]
            if had[s] == left[s]:
                break
            out.append((s, done[s]))
            had[s], done[s], t = had[s] + 1, done[s] + 1, t + 1
    return out


def test_schedule_equals_brute_force():
    for blocks, weights in [({"a": 9, "b": 20, "c": 4}, {"a": 0.5, "b": 0.3, "c": 0.2}), ({"a": 30, "b": 3, "c": 11, "d": 1}, {"a": 3, "b": 1, "c": 0.25, "d": 7}), ({"x": 5}, {"x": 1e-9})]:
        assert list(pm.edf_slots(blocks, weights)) == brute(blocks, weights)


def test_columns_never_clash(spark):
    frame = docs(spark).selectExpr("*", "7 as mix_hash", "8 as mix_rank", "9 as source_", "10 as hash", "11 as tie", "12 as part", "13 as block", "map('a', 1) as m")
    out = pm.mix(frame)
    assert out.columns[: len(frame.columns)] == frame.columns
    assert {(r.mix_hash, r.mix_rank, r.hash, r.tie, r.part, r.block) for r in out.select("mix_hash", "mix_rank", "hash", "tie", "part", "block").collect()} == {(7, 8, 10, 11, 12, 13)}
    again = pm.mix(out)
    assert again.columns == out.columns and again.count() == frame.count()


def test_rows_without_ids_are_dealt_out(spark):
    frame = spark.range(2000).selectExpr("cast(null as long) as doc_id", "'s' as source", "id as x")
    first, second = ({r.x: r.mix_position for r in pm.mix(f).collect()} for f in (frame, frame.repartition(7)))
    assert first == second and len(set(first.values())) == 2000


def test_every_row_once_and_prefixes_near_their_weights(spark):
    rows = [(i, "x" if i % 3 else "y") for i in range(900)] + [(5, "x"), (None, "x"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    out = pm.mix(frame, {"x": 0.25, "y": 0.75}, block_rows=4).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in out) == sorted((str(a), str(b)) for a, b in rows)
    assert len({r.mix_position for r in out}) == len(out)
    blocks = sorted({(r.mix_slot, r.mix_source) for r in out})
    assert len({s for s, _ in blocks}) == len(blocks)
    first = blocks[:60]
    # the null source takes the smallest weight given, for its one block
    want = {"x": 0.25, "y": 0.75}
    assert all(abs(sum(s == k for _, s in first[:t]) - t * w) < 3 for k, w in want.items() for t in range(1, 40))


def test_odd_and_empty_tables(spark):
    out = pm.mix(docs(spark).selectExpr("*", "1 as first", "2 as places", "3 as period", "4 as blocks"))
    assert out.count() == docs(spark).count() and "a.b" in out.columns
    assert pm.mix(empty(spark)).count() == 0


def test_blocks_keep_within_one_of_the_exact_weights():
    weights = {f"s{i:02}": 300**0.5 for i in range(19)} | {"hot": 2850**0.5, "rare": 0.01}
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total for s, w in weights.items()}
    had = dict.fromkeys(weights, 0)
    for t, (s, block) in enumerate(pm.edf_slots(dict.fromkeys(weights, 1 << 40), weights), 1):
        assert block == had[s]
        had[s] += 1
        # every source is looked at where it gets a block, and all now and then
        for x in weights if t % 997 == 0 else (s,):
            assert abs(had[x] - t * exact[x]) < 1
        if t == 60_000:
            break


def test_phases_place_all_blocks():
    slots = list(pm.edf_slots({"a": 3, "b": 50, "c": 0, "d": 1}, {"a": 0.5, "b": 0.25, "c": 1, "d": 1e-4}))
    assert len(slots) == 54 and len(set(slots)) == 54
    assert [b for s, b in slots if s == "b"] == list(range(50))
    assert list(pm.edf_slots({}, {})) == []
