import re
from itertools import permutations

from lodestone.llm.filter_audit import ORACLE, audit, masked, op13_filter_audit, parity_sums
from tests.oracle import given, wanted

from .fixtures import SCHEMA, SF, WORD, docs, empty, rows

LABELS = "doc_id long, quality int, toxic int, note string"


def failures(table):
    least = {}
    for r in table:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    out = []
    for r in table:
        text = r[1] or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": r[0] is not None and least[text] < r[0]}
        out.append("".join(k for k, v in fails.items() if v))
    return out


def brute(table, labels):
    good, toxic = ({x[0] for x in labels if x[i] == 1} - {None} for i in (1, 2))
    fails, found = failures(table), {}
    for part in {r[3] or "" for r in table}:
        mine = [(f, r[0] in good, r[0] in toxic) for r, f in zip(table, fails, strict=True) if (r[3] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order, 1):
                lost = [d for d in left if x in d[0]]
                gone = sum(x in d[0] for d in mine) - len(lost)
                left = [d for d in left if x not in d[0]]
                shapley[x] += len(lost)
                found[part, "".join(order), k] = [len(left), len(lost), gone, sum(d[0] == x for d in mine), sum(d[1] for d in lost), sum(d[2] for d in lost)]
        for key in found:
            if key[0] == part:
                found[key].append(shapley[key[1][key[2] - 1]])
    return found


def taken(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_equals_its_oracle(spark):
    assert given(op13_filter_audit(spark, SF)) == wanted(ORACLE, SF)


def test_equals_playing_every_order(spark):
    table = rows(60) + [(None, "word " * 900, None, None, None, None, None, None, None), (5, rows(60)[5][1], "en", "src1", 1, "x", "y", 1, 2), (3, "other text", "en", "src1", 1, "x", "y", 1, 2)]
    table += [(5000 + i, "copied many times", None, f"src{i % 3}", 0, None, None, None, None) for i in range(300)]
    labels = [(i, i % 2, None if i % 5 else 1, "x") for i in range(50)] + [(4, 1, 1, "y"), (5300 - 1, 1, 1, "z"), (None, 1, 1, "n")]
    found = taken(audit(spark.createDataFrame(table, SCHEMA), spark.createDataFrame(labels, LABELS)))
    assert found == brute(table, labels)


def test_parity_sums_of_a_part_start_with_its_rows(spark):
    sums = parity_sums(masked(docs(spark), spark.createDataFrame([], LABELS))).collect()
    assert sum(r.sums[0] for r in sums) == len(rows())
    assert all(len(r.sums) == 32 and r.good == r.toxic == 0 for r in sums)


def test_empty_table(spark):
    assert taken(audit(empty(spark), spark.createDataFrame([], LABELS))) == {}
