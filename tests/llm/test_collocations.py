import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import collocations as module
from lodestone.llm.collocations import CELLS, collocations, hot_cells, sketch_cells, word_keys
from lodestone.llm.slot_map import SlotMap

from .fixtures import LOWER, SCHEMA, docs, empty, rows


def brute(table, least, longest, top):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {p: n for p, n in counts.items() if n >= least}
    inner = defaultdict(set)
    for (lang, p), n in frequent.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inner[lang, p[i:j]].add(n)
    out = []
    for (lang, p), a in frequent.items():
        if len(p) > 1 and not any(100 * n >= 100 * a for n in inner[lang, p]):
            score, _, left, right = min((1000 * a * totals[lang] // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k, frequent[lang, p[:k]], frequent[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), left, right, totals[lang]))
    found, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return found


def taken(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("cells", "group_keys"), [(1 << 16, 1 << 20), (1 << 10, 400)])  # all keys at once; all cells hot and keys in many groups
def test_equals_counting_every_phrase(spark, cells, group_keys):
    table = rows(60) + [(i, "Alpha beta, alpha beta gamma delta alpha beta. alpha; beta! ÀB àb", "en", None, 1, "x", "y", 1, 2) for i in range(7)]
    found = taken(collocations(spark.createDataFrame(table, SCHEMA), least=5, top=300, cells=cells, group_keys=group_keys))
    assert found == sorted(brute(table, 5, 5, 300))
    assert len(found) > 50


def test_shorter_phrases_and_ties(spark):
    table = [(i, t, lang, None, None, None, None, None, None) for i, (t, lang) in enumerate([("b a b a b a", "x"), ("b a b a b a", "y"), (None, None), ("c d\tc d", None), ("a", "x")])]
    found = taken(collocations(spark.createDataFrame(table, SCHEMA), least=2, longest=3))
    assert found == sorted(brute(table, 2, 3, 2000))
    assert {r[0] for r in found} == {"x", "y", "und"}


@pytest.mark.parametrize("n", [10**7, 10**9, 10**10])
def test_cells_grow_with_the_corpus(n):
    assert n / sketch_cells(n, 100) <= 25
    assert sketch_cells(10**15, 100) == CELLS


def test_hot_cells_are_those_of_all_tasks_together(spark, monkeypatch):
    monkeypatch.setattr(module, "WAITING", 8)
    texts = ["a b a c", "a b", "b d e f g", "h " * 9, "", "b"]
    df = spark.createDataFrame([("x", t) for t in texts], "lang string, text string").repartition(3)
    batch = df.toArrow().to_batches()
    cells = 1 << 20  # several segments, all words apart
    keys = [k for b in batch for _, k in word_keys(b)]
    counts = np.sum([np.bincount(c, minlength=2 * cells) for k in keys for c in module._cells(k, cells)], axis=0)
    assert len({c // module.SEGMENT for c in np.flatnonzero(counts >= 2)}) > 2
    assert (np.unpackbits(hot_cells(df, word_keys, 2, cells)).astype(bool) == (counts >= 2)).all()


def test_a_task_gives_each_cell_once_in_few_bytes(monkeypatch):
    monkeypatch.setattr(module, "WAITING", 5000)
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 300) % 40_000) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 200), pa.array(texts)], ["lang", "text"])
    cells = 1 << 18
    out = [b for part in module.cell_counts(word_keys, 100, cells)(iter([batch.slice(i, 20) for i in range(0, 200, 20)])) for b in part.to_pylist()]
    at = np.concatenate([b["segment"] * module.SEGMENT + np.cumsum(module.heard(b["cells"]), dtype=np.int64) for b in out])
    counts = np.concatenate([np.frombuffer(b["counts"], np.uint8) for b in out])
    want = np.sum([np.bincount(c, minlength=2 * cells) for _, k in word_keys(batch) for c in module._cells(k, cells)], axis=0)
    assert (at == np.flatnonzero(want)).all() and (counts == np.minimum(want[at], 100)).all()
    # one or two bytes tell where a cell is, one how often it came
    assert sum(len(b["cells"]) + len(b["counts"]) for b in out) < 3.1 * len(at)


@pytest.mark.parametrize("most", [0, 255, 256, 70_000, 1 << 40])
def test_numbers_are_heard_as_told(most):
    x = np.array([0, most, most // 2, most], np.uint64)
    assert (module.heard(module.told(x)) == x).all() and (np.cumsum(module.heard(module.told(module.gaps(np.sort(x)))), dtype=np.uint64) == np.sort(x)).all()
    assert len(module.heard(module.told(x[:0]))) == 0


def test_empty_table(spark):
    assert taken(collocations(empty(spark), least=2, longest=2)) == []


def test_odd_rows_give_nothing_rare(spark):
    assert all(r[3] >= 100 for r in taken(collocations(docs(spark, 20), least=100, longest=3)))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_slots_are_minimal_and_others_have_none(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 50, (2 * n, 2), dtype=np.uint64), axis=0)[:n] if n < 100 else np.unique(rng.integers(0, 1 << 62, (n, 2), dtype=np.uint64), axis=0)
    found = SlotMap(keys[:, 0].copy(), keys[:, 1].copy())
    slots = found.slots(keys[:, 0], keys[:, 1])
    assert sorted(slots) == list(range(len(keys)))
    assert (found.a[slots] == keys[:, 0]).all()
    assert (found.slots(keys[:, 0] + np.uint64(1 << 63), keys[:, 1]) == -1).all()
