"""Language identification by a linear-chain conditional random field over words.

A word (a run of letters, lower-cased) has affix features (prefixes and suffixes of two and three
bytes), n-gram features (its two- and three-byte grams, edges marked) and a lexicon feature (the
whole word, if the training sample holds it twice). Weights are hashed into one table. A label
for each word comes from forward-backward with learned start and transition weights, so text
that switches language is labelled word by word; a document's language has the largest sum of
word posteriors.

Forward-backward runs over all words of a batch of texts at once: a text's first word has a
transition that forgets what came before, words are cut into blocks, the blocks' transfer
matrices are multiplied side by side and only block ends are walked in turn.

A text of more than STRETCH bytes goes through in stretches, cut between words: first each
stretch's transfer matrix, then, with the messages that reach it from both sides, its posteriors.
Nothing is approximate, and memory is that of one stretch beside the text.

The model is fitted on a bounded sample: at most `per_label` documents of each label, those with
the smallest id hashes, and of each at most `window` characters from a place that its hash
chooses (a window without a letter is left out). Word labels are the documents' labels; half of the training sequences
are made of short segments of different documents, which is where switches are learned.

Defined cases: a null text or one without a letter gives `und` and score 0, as does every text
when no labelled document with letters exists; labels tie by order; rows that repeat are labelled
each for itself; documents without a label or an id hash are no training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .packed import U, flat, gram, mixed, packs, sums, words
from .tables import fold, narrowed

NO_LETTER = np.ones(256, bool)
NO_LETTER[97:123] = False
NO_LETTER[128:] = False
UND = "und"
STRETCH = 1 << 20  # bytes of text that are tagged together


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # hashed feature, label
    steps: np.ndarray  # label before, label
    first: np.ndarray  # label
    lexicon: np.ndarray  # sorted word hashes


def features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hashed feature, value) of the words from start to end."""
    prefix, n = sums(buf), end - start
    which, what, value = [], [], []

    def add(rows: np.ndarray, h: np.ndarray, kind: int, v: np.ndarray) -> None:
        which.append(rows)
        what.append((mixed(h + U(kind)) % U(size)).astype(np.int64))
        value.append(v)

    every = np.arange(len(start))
    for kind, length in ((1, 2), (2, 3)):
        cut = np.minimum(n, length)
        add(every, gram(prefix, start, start + cut), kind, np.ones(len(start)))
        add(every, gram(prefix, end - cut, end), kind + 2, np.ones(len(start)))
    for kind, length in ((5, 2), (6, 3)):
        many = np.maximum(n - length + 1, 0)
        rows = np.repeat(every, many)
        at = np.repeat(start, many) + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        add(rows, gram(prefix, at, at + length), kind, (1 / np.sqrt(np.maximum(many, 1)))[rows])
    place = np.searchsorted(lexicon, hashes)
    known = np.flatnonzero(lexicon[np.minimum(place, len(lexicon) - 1)] == hashes) if len(lexicon) else every[:0]
    add(known, hashes[known], 7, np.ones(len(known)))
    return np.concatenate(which), np.concatenate(what), np.concatenate(value)


def emissions(weights: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    row, what, value = found
    return np.stack([np.bincount(row, value * weights[what, k], n) for k in range(weights.shape[1])], axis=1)


def forward_backward(emit: np.ndarray, opens: np.ndarray, steps: np.ndarray, first: np.ndarray, block: int = 256, before: np.ndarray | None = None, after: np.ndarray | None = None, only_transfer: bool = False):
    """Of each word: forward, backward, exp(emission) and posterior, rows scaled freely. opens: whether a word starts a text.

    before, after: messages that reach the first and the last word from outside. only_transfer: the product of all steps instead, label before by label at the end.
    """
    n, k = emit.shape
    blocks = -(-n // block)
    pad = blocks * block - n
    e = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -40))
    # step, label, block: each step is a few operations on long rows
    e = np.ascontiguousarray(np.concatenate((e, np.ones((pad, k)))).reshape(blocks, block, k).transpose(1, 2, 0))
    o = np.concatenate((opens, np.zeros(pad, bool))).reshape(blocks, block).T
    void = block - pad  # from this step on the last block has no words: messages pass through
    fresh = [np.flatnonzero(x) for x in o]
    a, pi = np.exp(steps - steps.max()), np.exp(first - first.max())
    # transfer matrix of each block: label at its end, label before it, block
    p = np.repeat(np.eye(k)[:, :, None], blocks, axis=2)
    for t in range(block):
        q = (a.T @ p.reshape(k, -1)).reshape(k, k, blocks)
        if len(at := fresh[t]):
            q[:, :, at] = pi[:, None, None] * p[:, :, at].sum(axis=0)
        if t >= void:
            q[:, :, -1] = p[:, :, -1]
        q *= e[t][:, None, :]
        p = q / q.max(axis=(0, 1)) if t % 4 == 3 else q
    p = np.ascontiguousarray((p / p.max(axis=(0, 1))).transpose(2, 1, 0))
    if only_transfer:
        whole = np.eye(k)
        for b in range(blocks):
            whole = whole @ p[b]
            whole /= whole.max()
        return whole
    left, right = np.empty((k, blocks)), np.empty((k, blocks))
    now = np.full(k, 1 / k) if before is None else before
    for b in range(blocks):
        left[:, b] = now
        now = now @ p[b]
        now /= now.sum()
    now = np.ones(k) if after is None else after
    for b in range(blocks - 1, -1, -1):
        right[:, b] = now
        now = p[b] @ now
        now /= now.max()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = left
    for t in range(block):
        new = a.T @ now
        if len(at := fresh[t]):
            new[:, at] = pi[:, None]
        if t >= void:
            new[:, -1] = now[:, -1]
        new *= e[t]
        now = new / new.sum(axis=0)
        alpha[t] = now
    now = right
    for t in range(block - 1, -1, -1):
        beta[t] = now
        seen = e[t] * now
        new = a @ seen
        if len(at := fresh[t]):
            new[:, at] = pi @ seen[:, at]
        if t >= void:
            new[:, -1] = now[:, -1]
        now = new / new.max(axis=0)
    alpha, beta, e = (x.transpose(2, 0, 1).reshape(-1, k)[:n] for x in (alpha, beta, e))
    post = alpha * beta
    return alpha, beta, e, post / post.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], size: int = 1 << 16, rounds: int = 30, rate: float = 0.15, decay: float = 1e-6, seed: int = 8) -> Crf:
    """texts: lower-cased, with a letter each."""
    labels = sorted(set(langs))
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    start, end, n = words(buf, offsets, NO_LETTER)
    hashes, index, which, times = np.unique(gram(sums(buf), start, end), return_index=True, return_inverse=True, return_counts=True)
    lexicon = hashes[times > 1]
    found = features(buf, start[index], end[index], hashes, lexicon, size)
    truth = np.repeat([labels.index(x) for x in langs], n)
    opens = np.zeros(len(which), bool)
    opens[(np.cumsum(n) - n)[n > 0]] = True
    # whole documents, and the same words again as shuffled segments that switch between documents
    rng = np.random.Generator(np.random.PCG64(seed))
    cut = opens | (rng.random(len(which)) < 1 / 12)
    segment = np.cumsum(cut) - 1
    order = np.argsort(rng.permutation(segment[-1] + 1)[segment], kind="stable")
    again = np.zeros(len(which), bool)
    again[0] = True
    again |= cut[order] & (rng.random(len(which)) < 1 / 8)
    which, truth, opens = np.concatenate((which, which[order])), np.concatenate((truth, truth[order])), np.concatenate((opens, again))
    k = len(labels)
    crf = Crf(labels, np.zeros((size, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    exact = np.zeros((len(truth), k))
    exact[np.arange(len(truth)), truth] = 1
    inner = ~opens[1:]
    pairs = np.bincount(truth[:-1][inner] * k + truth[1:][inner], minlength=k * k).reshape(k, k)
    params = [crf.weights, crf.steps, crf.first]
    mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    row, what, value = found
    for i in range(1, rounds + 1):
        emit = emissions(crf.weights, found, len(hashes))[which]
        alpha, beta, e, post = forward_backward(emit, opens, crf.steps, crf.first)
        miss = exact - post
        by_word = np.stack([np.bincount(which, miss[:, j], len(hashes)) for j in range(k)], axis=1)
        pull = np.stack([np.bincount(what, value * by_word[row, j], size) for j in range(k)], axis=1)
        tie, ahead = np.exp(crf.steps), (e * beta)[1:]
        mass = np.einsum("nk,nk->n", alpha[:-1] @ tie, ahead)
        xi = tie * ((alpha[:-1] * (inner / mass)[:, None]).T @ ahead)
        grads = [pull / len(truth) - decay * crf.weights, (pairs - xi) / len(truth), miss[opens].sum(axis=0) / len(truth)]
        for x, g, m, s in zip(params, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x += rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
    crf.weights = crf.weights.astype(np.float32)
    return crf


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 80, window: int = 2000, **options) -> Crf | None:
    """Fit on at most `per_label` documents of each label, and `window` characters of each, among those for which `learn` (on column id) holds."""
    rows = narrowed(docs, id=id_col, text=text_col, lang=lang_col).where("lang is not null and id is not null and text is not null").where(learn).where(has_letter("text"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(8), "id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # a slice of the hashes that holds about four times what is needed, then exactly that
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * (per_label + 8) / n))])
    near = rows.where((F.pmod("h", F.lit(1 << 40)) / float(1 << 40)) < part[F.col("lang")])
    best = Window.partitionBy("lang").orderBy("h", "id", "text")
    place = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
    sample = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_label).select("lang", "r", F.substr("text", place, F.lit(window)).alias("text")).where(has_letter("text")).orderBy("lang", "r").toPandas()
    if not len(sample):
        return None
    return fit(pa.compute.utf8_lower(pa.array(sample["text"], pa.string())).to_pylist(), sample["lang"].tolist(), **options)


def has_letter(text: str) -> Column:
    return F.coalesce(F.regexp_like(F.col(f"`{text}`"), F.lit(r"\p{L}")), F.lit(False))


def _emitted(crf: Crf, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    hashes, index, which = np.unique(gram(sums(buf), start, end), return_index=True, return_inverse=True)
    return emissions(crf.weights, features(buf, start[index], end[index], hashes, crf.lexicon, len(crf.weights)), len(hashes))[which]


def _tagged(crf: Crf, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, n = words(buf, offsets, NO_LETTER)
    if not len(start):
        return start, end, n, np.zeros((0, len(crf.labels)))
    opens = np.zeros(len(start), bool)
    opens[(np.cumsum(n) - n)[n > 0]] = True
    return start, end, n, forward_backward(_emitted(crf, buf, start, end), opens, crf.steps, crf.first)[3]


def _stretches(buf: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Parts of a text of about `size` bytes (a longer word stays whole), none of which cuts a word."""
    cuts, at = [0], size
    while at < len(buf):
        while at < len(buf) and not (gaps := np.flatnonzero(NO_LETTER[buf[at : at + 65536]])).size:
            at += 65536
        at = min(at + int(gaps[0]), len(buf)) if at < len(buf) else len(buf)
        cuts.append(at)
        at += size
    if cuts[-1] < len(buf):
        cuts.append(len(buf))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _long(crf: Crf, buf: np.ndarray, size: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(where it begins, start, end, posteriors) of each stretch of one text."""
    held = [(lo, hi, *words(buf[lo:hi], np.array([0, hi - lo]), NO_LETTER)[:2]) for lo, hi in _stretches(buf, size)]
    held = [x for x in held if len(x[2])]
    opening = lambda i, n: np.append(i == 0, np.zeros(n - 1, bool))
    steps = [forward_backward(_emitted(crf, buf[lo:hi], start, end), opening(i, len(start)), crf.steps, crf.first, only_transfer=True) for i, (lo, hi, start, end) in enumerate(held)]
    k = len(crf.labels)
    before, after = [np.full(k, 1 / k)], [np.ones(k)]
    for step in steps[:-1]:
        now = before[-1] @ step
        before.append(now / now.sum())
    for step in steps[:0:-1]:
        now = step @ after[-1]
        after.append(now / now.max())
    for i, (lo, hi, start, end) in enumerate(held):
        yield lo, start, end, forward_backward(_emitted(crf, buf[lo:hi], start, end), opening(i, len(start)), crf.steps, crf.first, before=before[i], after=after[len(held) - 1 - i])[3]


def _identified(crf: Crf | None, at: int, shown: int):
    """at: the text's column; the first `shown` columns go on."""

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in packs(batches, at, STRETCH):
            sure = rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(len(rows), UND, object), np.zeros(len(rows))
            if crf is not None:
                buf, offsets = flat(pa.compute.utf8_lower(rows.column(at)))
                buf, offsets = buf[offsets[0] : offsets[-1]], offsets - offsets[0]
                if len(buf) > 2 * STRETCH and len(rows) == 1:
                    n, total = np.zeros(1, np.int64), np.zeros((1, len(crf.labels)))
                    for _, start, _, post in _long(crf, buf):
                        n += len(start)
                        total += post.sum(axis=0)
                else:
                    _, _, n, post = _tagged(crf, buf, offsets)
                    first = np.cumsum(n) - n
                    running = np.concatenate((np.zeros((1, len(crf.labels))), np.cumsum(post, axis=0)))
                    total = running[first + n] - running[first]
                has = np.flatnonzero(sure & (n > 0))
                share = total[has] / n[has, None]
                pred[has] = np.array(crf.labels, object)[share.argmax(axis=1)] if len(has) else UND
                score[has] = np.clip(share.max(axis=1), 0, 1) if len(has) else 0
            names = rows.schema.names[:shown]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(shown)), pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return identify


def identify(docs: DataFrame, crf: Crf | None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` (default: doc_id), lang_pred, score (its mean word posterior) of every row."""
    names = keep or ["doc_id"]
    held = [*names] if text_col in names else [*names, text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(held)], has_letter(text_col).alias("lettered"))
    schema = StructType([*rows.schema.fields[: len(names)], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_identified(crf, held.index(text_col), len(names)), schema).toDF(*names, "lang_pred", "score")


def _labelled(crf: Crf):
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in packs(batches, "text", STRETCH):
            if len(rows) == 1 and len(buf) > 2 * STRETCH:
                parts = [(lo + start, lo + end, post) for lo, start, end, post in _long(crf, buf)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(crf.labels))))]
                start, end, post = (np.concatenate(x) for x in zip(*parts, strict=True))
                n = np.array([len(start)])
            else:
                start, end, n, post = _tagged(crf, buf, offsets)
            best, data = post.argmax(axis=1), buf.tobytes()
            each = [{"word": data[s:e].decode("utf-8", "replace"), "lang": crf.labels[b], "score": float(p[b])} for s, e, b, p in zip(start, end, best, post, strict=True)]
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([each[b - m : b] for b, m in zip(ends, n, strict=True)], kind)], ["id", "words"])

    return label


def tag_words(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and its words in order, each with the likeliest language and that one's posterior."""
    rows = narrowed(docs, id=id_col, text=text_col).select("id", F.lower("text").alias("text"))
    return rows.mapInArrow(_labelled(crf), f"id {docs.schema[id_col].dataType.simpleString()}, words array<struct<word:string,lang:string,score:double>>")


def op8_crf_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crf = train(docs, fold("id", 4) != 2)
    out = identify(docs, crf)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
