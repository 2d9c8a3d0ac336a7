import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from lodestone.llm import unigram_pieces as up
from tests.llm.fixtures import docs, empty, rows


@pytest.fixture(scope="module")
def vocabulary():
    return up.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    """The public library's own unigram model over the same pieces and scores."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def block(field, body):
        return number(field << 3 | 2) + number(len(body)) + body

    m, blob = sentencepiece.SentencePieceProcessor(model_file=up.MODEL), b""
    for i in range(m.get_piece_size()):
        kind = 2 if m.is_unknown(i) else 3 if m.is_control(i) else 6 if m.is_byte(i) else 1
        blob += block(1, block(1, m.id_to_piece(i).encode()) + number(2 << 3 | 5) + struct.pack("<f", vocabulary.score[i]) + number(3 << 3) + number(kind))
    blob += block(2, number(3 << 3) + number(1) + number(35 << 3) + number(1)) + block(3, block(1, b"identity") + number(3 << 3) + number(1) + number(4 << 3) + number(0) + number(5 << 3) + number(1))
    return sentencepiece.SentencePieceProcessor(model_proto=blob)


TEXTS = ["", "a", "  a  b ", "日本語 🎉 test\n\n\ttab", "é" * 50, "   ", "Ünï—“quotes” … ©", "The quick brown fox", "a" * 500]


def encoded(v, texts):
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    return pa.Table.from_batches(list(up._encoded(v)(iter([batch])))).to_pydict()["ids"]


def test_scores_equal_the_library(vocabulary, library):
    texts = TEXTS + [w for r in rows(30) for w in (r[1] or "").split(" ")[:40]]
    for text, ids in zip(texts, encoded(vocabulary, texts), strict=True):
        want = library.encode(text)
        total = lambda x: sum(vocabulary.score[i] for i in x)
        bytes_ = set(vocabulary.byte_id.tolist())
        assert [i in bytes_ for i in ids].count(True) == [i in bytes_ for i in want].count(True)
        assert ids == want or abs(total(ids) - total(want)) < 1e-3


def test_best_path_by_brute_force():
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab"]
    score = np.array([0.0] * 257 + [-3.0, -2.0, -2.5, -2.2, -3.1, -4.0, -2.1, -5.0])
    v = up.vocabulary(names, score, [True] + [False] * 264, [False] + [True] * 256 + [False] * 8)
    at = {n: i for i, n in enumerate(names)}

    def best(s):
        if not s:
            return 0.0
        return max([score[at[s[:k]]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in at and not s[:k].startswith("<")], default=-np.inf)

    for text in ["ab", "abab", "bab aab", "aaabbb", "b ab ba bab"]:
        ids = encoded(v, [text])[0]
        assert abs(sum(score[i] for i in ids) - best("▁" + text.replace(" ", "▁"))) < 1e-5


def test_round_trip(spark, vocabulary):
    back = {r.id: r.text for r in up.decode(up.encode(docs(spark), vocabulary), vocabulary).collect()}
    assert back == {r[0]: r[1] for r in rows()}
    assert up.decode(up.encode(empty(spark), vocabulary), vocabulary).count() == 0


def test_texts_without_blanks(vocabulary, library):
    import time

    rng = np.random.default_rng(2)
    chinese = "".join(chr(x) for x in rng.integers(0x4E00, 0x9FA5, 20_000))
    common = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里"
    texts = [chinese, "".join(common[i] for i in rng.integers(0, len(common), 20_000)), "".join("ABCDabcdxyz0189+/"[i] for i in rng.integers(0, 17, 3000)), "é日" * 300 + "plain" * 200]
    for text in texts:
        ids = encoded(vocabulary, [text])[0]
        want = library.encode(text)
        assert ids == want or abs(sum(vocabulary.score[i] for i in ids) - sum(vocabulary.score[i] for i in want)) < 1e-6 * len(text)
    began = time.perf_counter()
    encoded(vocabulary, [chinese])
    assert time.perf_counter() - began < 1.5


def test_cuts_change_no_path(vocabulary):
    rng = np.random.default_rng(3)
    for letters in ("abcde", "the quick", "xQ7+é日本"):
        raw = "".join(letters.replace(" ", "")[i] for i in rng.integers(0, len(letters.replace(" ", "")), 700)).encode()
        buf, lo, hi = np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)])
        a, b = up.segment(vocabulary, buf, lo, hi), up._segment(vocabulary, buf, lo, hi)
        assert b[1] == a[1] and np.array_equal(a[0], b[0]) or abs(vocabulary.score[a[0]].sum() - vocabulary.score[b[0]].sum()) < 1e-6


def test_runs_of_one_character(vocabulary, library):
    import time

    for unit in (" ", "_", "a", "=", "é", "ab", "\n", "🎉", "\x01"):
        text = unit * 3000
        ids, want = encoded(vocabulary, [text])[0], library.encode(text)
        assert ids == want or abs(sum(vocabulary.score[i] for i in ids) - sum(vocabulary.score[i] for i in want)) < 1e-6 * len(text)
        assert up.decode_pack(vocabulary, np.array(ids), np.array([len(ids)])) == [text]
    for unit in (" ", "_", "a"):
        began = time.perf_counter()
        encoded(vocabulary, [unit * 40_000])
        assert time.perf_counter() - began < 3


def test_long_parts_take_the_same_path(vocabulary):
    """Both walks agree piece by piece, with windows that end inside pieces."""
    rng = np.random.default_rng(4)
    for letters in ("a", "ab", " ", "_-", "é日a", "abcde", "=#"):
        raw = "".join(letters[i] for i in rng.integers(0, len(letters), 400)).encode()
        buf = up.marked(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        want = up._segment(vocabulary, buf, np.array([0]), np.array([len(buf)]))[0]
        for window in (7, 1 << 14):
            assert np.array_equal(up._crossed(vocabulary, buf, window), want)
    lo, hi = np.array([0, 0, 3, 10]), np.array([5, 400, 330, 10])
    for narrow in (0, 20, 10_000):
        ids, many = up.segment(vocabulary, buf, lo, hi, narrow=narrow)
        assert np.array_equal(ids, np.concatenate([up._segment(vocabulary, buf, lo[k : k + 1], hi[k : k + 1])[0] for k in range(4)])) and many.sum() == len(ids)
