import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import crf_language as crf
from lodestone.llm.tables import fold
from tests.llm.fixtures import docs, empty


def slow(emit, opens, steps, first):
    """Posteriors one text after the other, by log sums."""
    out, starts = np.zeros_like(emit), [*np.flatnonzero(opens), len(emit)]
    for a, b in zip(starts, starts[1:], strict=False):
        alpha, beta = np.zeros((b - a, emit.shape[1])), np.zeros((b - a, emit.shape[1]))
        alpha[0] = first + emit[a]
        for t in range(1, b - a):
            alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + steps, axis=0) + emit[a + t]
        for t in range(b - a - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(steps + (emit[a + t + 1] + beta[t + 1])[None, :], axis=1)
        p = alpha + beta
        out[a:b] = np.exp(p - np.logaddexp.reduce(p, axis=1, keepdims=True))
    return out


def test_blocked_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    emit, steps, first = rng.normal(0, 3, (500, 4)), rng.normal(0, 1, (4, 4)), rng.normal(0, 1, 4)
    opens = rng.random(500) < 0.03
    opens[0] = True
    for block in (7, 64, 1000):
        assert np.allclose(crf.forward_backward(emit, opens, steps, first, block)[3], slow(emit, opens, steps, first), atol=1e-6)


def test_held_out_accuracy_and_odd_rows(spark):
    frame = docs(spark, 200)
    model = crf.train(frame, fold("id", 4) != 2)
    out = {r.doc_id: r for r in crf.identify(frame, model).collect()}
    truth = {r.doc_id: r.lang for r in frame.where((fold("doc_id", 4) == 2) & F.col("lang").isNotNull() & (F.length("text") > 200)).collect() if r.doc_id < 100_000}
    assert np.mean([out[i].lang_pred == lang for i, lang in truth.items()]) > 0.95
    assert all(out[100_000 + k].lang_pred == "und" and out[100_000 + k].score == 0 for k in (0, 1, 2, 10))
    assert all(0 <= r.score <= 1 for r in out.values())


def test_words_of_a_mixed_text(spark):
    frame = docs(spark, 200)
    model = crf.train(frame, F.lit(True))
    text = "the and that was with of from this thing und der die nicht auf den das eine mit von"
    got = crf.tag_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().words
    assert [w.word for w in got] == text.split()
    assert np.mean([w.lang == ("en" if k < 9 else "de") for k, w in enumerate(got)]) > 0.8


def test_nothing_to_learn_from(spark):
    assert crf.train(empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in crf.identify(docs(spark, 3), None).collect()} == {"und"}
    assert crf.identify(empty(spark), None).count() == 0


def test_stretches_of_a_long_text_are_exact(spark):
    frame = docs(spark, 200)
    model = crf.train(frame, F.lit(True))
    text = " ".join(r.text for r in frame.where("text is not null").collect())[:60_000].lower() + " " + "z" * 9000
    buf = np.frombuffer(text.encode(), np.uint8)
    start, end, _, post = crf._tagged(model, buf, np.array([0, len(buf)]))
    parts = list(crf._long(model, buf, 5000))
    assert len(parts) > 5
    assert np.array_equal(np.concatenate([lo + s for lo, s, _, _ in parts]), start)
    assert np.allclose(np.concatenate([p for *_, p in parts]), post, atol=1e-9)


def test_repeated_rows_and_extra_columns(spark):
    frame = docs(spark, 30)
    model = crf.train(frame, F.lit(True))
    twice = frame.union(frame)
    once = {(r.doc_id, r.lang_pred, r.score) for r in crf.identify(frame, model).collect()}
    rows = [(r.doc_id, r.lang_pred, r.score) for r in crf.identify(twice, model).collect()]
    assert len(rows) == 2 * frame.count() and set(rows) == once
    wide = crf.identify(frame, model, keep=["a.b", "text", "row", "doc_id"])
    assert wide.columns == ["a.b", "text", "row", "doc_id", "lang_pred", "score"] and wide.count() == frame.count()


def test_training_windows_are_bounded(spark):
    long = spark.createDataFrame([(i, "der die das und " * 5000 if i % 2 else "the of and with " * 5000, "de" if i % 2 else "en") for i in range(6)], "doc_id long, text string, lang string")
    model = crf.train(long, F.lit(True), window=400)
    assert [r.lang_pred for r in crf.identify(long, model).orderBy("doc_id").collect()] == ["en", "de"] * 3
