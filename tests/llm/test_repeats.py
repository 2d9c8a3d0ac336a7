import hashlib
from collections import Counter

import pytest

from lodestone.llm.repeats import remove_repeats
from tests.llm.fixtures import docs, empty, rows


def brute(items, length=200):
    raw = [(i, (t or "").encode()) for i, t in items]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                for x in range(max(k, end), k + length):
                    gone[x] = 1
                end = k + length
        spans = sum(gone[x] and not (x and gone[x - 1]) for x in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [4096, 2])
def test_equals_brute_force(spark, crowd):
    got = sorted(tuple(r) for r in remove_repeats(docs(spark), crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute([(r[0], r[1]) for r in rows()])


def test_empty_table(spark):
    assert remove_repeats(empty(spark)).count() == 0


def test_equal_rows_and_rows_without_ids(spark):
    from tests.llm.fixtures import SCHEMA

    long = "".join(f"sentence {i} of a text that comes often; " for i in range(20))
    table = [(i, t) for i, t in [(1, long), (1, long), (1, long), (None, long), (None, "before " + long[:400]), (2, "x" * 150), (2, "x" * 150), (3, "y" * 300), (4, None), (None, None), (5, long[100:700] + " after")]]
    frame = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in table], SCHEMA)
    got = [tuple(r) for r in remove_repeats(frame).collect()]
    assert sorted((str(-1 if r[0] is None else r[0]), *r[1:]) for r in got) == sorted((str(r[0]), *r[1:]) for r in brute([(-1 if i is None else i, t) for i, t in table]))


def test_many_equal_rows_stay_linear(spark):
    from lodestone.llm import repeats

    text = "".join(f"line {i} of one text; " for i in range(60))
    frame = spark.range(300).selectExpr("1L as doc_id", f"'{text}' as text")
    out = remove_repeats(frame)
    assert out.count() == 300 and out.where("n_removed <> n_bytes or n_spans <> 1").count() == 0
    assert repeats.repeated_runs(frame.limit(1).selectExpr("7L as k", "text")).count() == 0


def test_bucket_pointers_are_equal_where_bytes_are():
    import numpy as np

    from lodestone.llm.repeats import refined

    rng = np.random.default_rng(9)
    for length in (8, 9, 40, 200):
        part = rng.integers(0, 3, 300).astype(np.uint8)
        data = np.concatenate((part, rng.integers(0, 256, 90).astype(np.uint8), part[20:], part[:250], np.zeros(260, np.uint8)))
        ids, raw = refined(data, length), data.tobytes()
        strings = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        number = {x: i for i, x in enumerate(dict.fromkeys(strings))}
        pairs = {(number[x], i) for x, i in zip(strings, ids.tolist(), strict=True)}
        assert len(ids) == len(strings) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
