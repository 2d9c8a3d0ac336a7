"""Secret scans whose false positives a random forest removes.

Candidates are values of known shapes, values assigned to a name, and long tokens of mixed
letters and digits. A forest (pyspark.ml) then scores each on its length, its character
transitions (changes of class, and how unlike the text around them its letter pairs are), how
much of it dictionary words cover, the path of its document and the words beside it. It is
trained from labelled findings; `labelled_findings` makes a fixed set of them around the
dictionary's words, any other frame with the same columns will do. The dictionary is learned:
the words that most documents hold, a bounded number, counted over all of them.

Offsets are code points, ends exclusive. Overlapping candidates: the earlier kind of CANDIDATES
wins. Values have no greatest length, and every pattern is linear in the text's length.

Defined cases: null and empty texts have no findings; a null path counts as ''; each row is
scanned for itself, whatever repeats, rows without an id too; an empty table teaches no words
beyond DICTIONARY; other columns pass through `redact` untouched.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .context_mixing import commonest
from .tables import discard, keep, narrowed, shared_dir

# Published shapes of credentials, names that announce one, words that deny one.
SHAPES = {
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,20}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*+)",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "jwt": r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})[A-Za-z0-9_-]*?(?<![A-Za-z0-9])(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)",
    "api_key": r"(?<![A-Za-z0-9])(?:sk|pk|rk)[_-](?:live|test|proj)?[_-]?[A-Za-z0-9]{20,}+",
}
NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "auth", "credential", "private_key", "client_secret", "bearer")
DENIALS = ("example", "sample", "dummy", "placeholder", "test", "fake", "changeme", "your", "xxxx", "todo", "redacted", "none", "null")
BENIGN = ("sha1", "sha256", "md5", "hash", "checksum", "digest", "commit", "revision", "uuid", "guid", "id", "etag", "version", "isbn", "color", "integrity")
PLACES = ("test", "example", "sample", "doc", "fixture", "spec", "mock")
DICTIONARY = ("access", "account", "admin", "example", "password", "secret", "token", "login", "value", "string", "default", "config", "setting", "public", "private", "server", "client", "service", "hello", "world", "letmein", "qwerty", "welcome", "change", "enter", "insert", "replace", "demo", "name", "user", "here", "key")
BASE = frozenset(DICTIONARY)

_NAMED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]++)[\"']?[\x20\t]{0,3}(?::=|=>|[:=])[\x20\t]{0,3}")
_VALUE = re.compile(r"[\"']([^\"'\s]{6,}+)[\"']|([^\s\"',;]{8,}+)")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}+")
_SHAPED = [(kind, re.compile(p), p.split("(?:")[0][-3:]) for kind, p in SHAPES.items()]
_CUES = {"private_key": "-----BEGIN", "aws_key": "IA", "github_token": "gh", "slack_token": "xox", "jwt": "eyJ", "api_key": "k"}
_WORDS = re.compile(r"[a-z]+")
_LEARNED = re.compile(r"(?<!\w)[^\W\d_]{4,20}(?!\w)")
_LETTERS = re.compile(r"[^\W\d_]{4,}")
SHORTEST, LONGEST = 4, 20  # letters of a dictionary word
_CLASSES = str.maketrans(string.ascii_lowercase + string.ascii_uppercase + string.digits, "l" * 26 + "u" * 26 + "d" * 10)
FEATURES = ["length", "entropy", "pair_cost", "changes", "digits", "uppers", "others", "hexadecimal", "words", "denied", "named", "benign", "shaped", "quoted", "path"]
AROUND = 48


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, quoted), in order, without overlaps."""
    found: list[tuple[int, int, str, bool]] = []
    for kind, pattern, _ in _SHAPED:
        if _CUES[kind] in text:
            found += [(*m.span(m.lastindex or 0), kind, False) for m in pattern.finditer(text)]
    if "=" in text or ":" in text:
        past = 0  # where the last assigned value ended
        for m in _NAMED.finditer(text):
            # a value may hold names, but is read once
            if m.start() >= past and any(x in m[1].lower() for x in NAMES) and (value := _VALUE.match(text, m.end())):
                found.append((*value.span(value.lastindex), "assigned", value.lastindex == 1))
                past = value.end()
    for m in _LONG.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            found.append((*m.span(), "long_token", False))
    taken: list[tuple[int, int, str, bool]] = []
    order = {kind: i for i, kind in enumerate([*SHAPES, "assigned", "long_token"])}
    for x in sorted(found, key=lambda x: (order[x[2]], x[0], -x[1])):
        i = bisect(taken, x)
        if (i == 0 or taken[i - 1][1] <= x[0]) and (i == len(taken) or x[1] <= taken[i][0]):
            taken.insert(i, x)
    return taken


def pair_model(text: str) -> tuple[Counter, Counter]:
    """Letter pairs and first letters of a text's words."""
    low = text.lower()
    pairs, firsts = Counter(), Counter()
    for w, n in Counter(_WORDS.findall(low)).items():
        for a, b in zip(w, w[1:], strict=False):
            pairs[a + b] += n
            firsts[a] += n
    return pairs, firsts


def covered(low: str, words: frozenset[str]) -> int:
    """The most letters of a lower-cased value that words side by side can cover; linear in its length."""
    total = 0
    for run in _LETTERS.findall(low):
        best = [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            best[end] = best[end - 1]
            for n in range(SHORTEST, min(LONGEST, end) + 1):
                if best[end - n] + n > best[end] and run[end - n : end] in words:
                    best[end] = best[end - n] + n
        total += best[-1]
    return total


def measures(text: str, path: str, start: int, end: int, kind: str, quoted: bool, model: tuple[Counter, Counter], words: frozenset[str] = BASE) -> list[float]:
    value = text[start:end]
    low, n = value.lower(), max(1, end - start)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    pairs, firsts = model
    cost = [-math.log2((pairs[a + b] + 0.5) / (firsts[a] + 0.5 * 36)) for a, b in zip(low, low[1:], strict=False)]
    classes = value.translate(_CLASSES)
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n
    digits, uppers, lowers = classes.count("d"), classes.count("u"), classes.count("l")
    before, after = text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND // 2].lower()
    beside = set(_WORDS.findall(before)) | set(re.findall(r"[a-z0-9_]+", before))
    near = before[-24:]
    return [
        math.log2(n), entropy, sum(cost) / max(1, len(cost)), changes, digits / n, uppers / n, (n - digits - uppers - lowers) / n, float(all(c in "0123456789abcdef" for c in low)),
        covered(low, words) / n, float(any(x in low for x in DENIALS) or any(x in beside for x in DENIALS) or any(x in after for x in DENIALS)), float(any(x in near for x in NAMES)), float(any(x in beside for x in BENIGN)),
        float(kind in SHAPES), float(quoted), float(any(x in path.lower() for x in PLACES)),
    ]


FOUND = ", ".join(["id {id}", "start int", "end int", "kind string", *(f"{x} double" for x in FEATURES)])


def _scanned(words):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = [], []
            for i, (text, path) in enumerate(zip(batch.column("text").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                found = candidates(text) if text else []
                model = pair_model(text) if found else None
                owners += [i] * len(found)
                rows += [(s, e, kind, *measures(text, str(path or ""), s, e, kind, quoted, model, words.value)) for s, e, kind, quoted in found]
            columns = list(zip(*rows, strict=True)) or [()] * (3 + len(FEATURES))
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * len(FEATURES)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "start", "end", "kind", *FEATURES])

    return scanned


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", words: frozenset[str] = BASE) -> DataFrame:
    """Each candidate's id, start, end, kind and features. words: the dictionary, broadcast; bounded where it is learned."""
    rows = narrowed(docs, id=id_col, text=text_col, path=path_col).where("text is not null")
    return rows.mapInArrow(_scanned(docs.sparkSession.sparkContext.broadcast(words)), FOUND.format(id=docs.schema[id_col].dataType.simpleString()))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents that hold it), added up for many documents at a time."""
    counts: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "c"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column("text"):
            counts.update(set(_LEARNED.findall(text.as_py().lower())))
            if len(counts) > 200_000:
                yield flushed()
    yield flushed()


def learned_words(docs: DataFrame, text_col: str = "text", most: int = 65_536) -> frozenset[str]:
    """DICTIONARY and the words of 4 to 20 letters that most documents hold, two at least: all that more than some number of documents hold, `most` at the most."""
    counts = narrowed(docs, text=text_col).where("text is not null").mapInArrow(_held, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 1")
    counts = keep(counts)
    words = frozenset(commonest(counts, most).select("word").toArrow().column("word").to_pylist())
    discard(counts)
    return words | BASE


def labelled_findings(n: int = 1200, seed: int = 2, words: frozenset[str] = BASE) -> list[tuple[str, str, bool]]:
    """(text, path, whether its first candidate is a secret): a fixed set of labelled findings for a dictionary; every second word around them and the words in placeholders are its."""
    known = sorted(words)
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    syllables = ["the", "er", "on", "an", "re", "ti", "en", "st", "la", "de", "ment", "ung", "cion", "el", "ou", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(rng.choice(known) if i % 2 else word() for i in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    secrets = [lambda: pick(hexes, rng.choice([32, 40, 48, 64])), lambda: pick(alnum, rng.randint(20, 64)), lambda: pick(alnum + "+/", rng.randint(24, 64)) + "=", lambda: pick(alnum + "!#%&*?", rng.randint(8, 24))]
    shaped = [lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "xoxb-" + pick(alnum, 40), lambda: "sk_live_" + pick(alnum, 24), lambda: f"eyJ{pick(alnum, 30)}.{pick(alnum, 60)}.{pick(alnum, 43)}"]
    weak = [lambda: rng.choice(["your_token_here", "changeme_please", "xxxxxxxxxxxxxxxx", "example_password_1", "<placeholder>", "none_provided", "test_secret_value"]), lambda: "_".join(rng.choice(known) for _ in range(3)), lambda: "".join(rng.choice(known) for _ in range(rng.randint(2, 5))), lambda: "config." + word() + "." + word() + "(1)", lambda: word() + word()]
    hashes = [lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: f"{pick(hexes, 8)}-{pick(hexes, 4)}-4{pick(hexes, 3)}-a{pick(hexes, 3)}-{pick(hexes, 12)}"]
    out = []
    for i in range(n):
        path = rng.choice(["src%d" % rng.randint(0, 30), "app/main.py", "conf/prod.yaml", "web", "mail"])
        left, right = prose(rng.randint(8, 60)), prose(rng.randint(8, 60))
        case = i % 6
        if case == 0:
            name, quote = rng.choice(NAMES), rng.choice(['"', "'", ""])
            text, secret = f"{left} {name}{rng.choice([' = ', '=', ': '])}{quote}{rng.choice(secrets)()}{quote} {right}", True
        elif case == 1:
            text, secret = f'{left} {rng.choice(["", "key ", "export X ", "use "])}{rng.choice(shaped)()} {right}', True
        elif case == 2:
            name = rng.choice(NAMES)
            text, secret = f'{left} {name} = "{rng.choice(secrets)()}" {right}', True
        elif case == 3:
            text, secret = f"{left} {rng.choice(NAMES)} = {rng.choice(['', chr(34)])}{rng.choice(weak)()} {right}", False
        elif case == 4:
            text, secret = f"{left} {rng.choice(BENIGN)}{rng.choice([' ', ': ', ' = '])}{rng.choice(hashes)()} {right}", False
        else:
            token = rng.choice([lambda: "-".join(word() for _ in range(6)) + str(rng.randint(1, 99)), lambda: "/".join(word() for _ in range(6)) + "/v2", lambda: f"www.{word()}{word()}{word()}.com/{word()}{rng.randint(1, 9999)}", lambda: f"{word()}_{word()}_{word()}_{word()}_{rng.randint(1, 2030)}"])()
            if rng.random() < 0.3:
                path, token = rng.choice(["tests/data.py", "docs/example.md"]), rng.choice(shaped)()
                left += " example"
            text, secret = f"{left} {token} {right}", False
        out.append((text, path, secret))
    return out


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 2, words: frozenset[str] = BASE, most: int = 20_000) -> PipelineModel:
    """findings: text, path, secret. Each row's first candidate gets the row's label. most: the forest is fitted on this many distinct findings at the most, by hash."""
    spark = findings.sparkSession
    numbered = findings.select(F.xxhash64("text", "path", "secret").alias("doc_id"), "text", F.col("path").alias("source"), F.col("secret").cast("double").alias("label"))
    first = scan(numbered, words=words).groupBy("id").agg(F.min_by(F.struct(*FEATURES), "start").alias("f")).select("id", "f.*")
    # in order and in one partition: a forest then doesn't depend on how the sample was dealt out
    rows = first.join(numbered.select(F.col("doc_id").alias("id"), "label").distinct(), "id").orderBy("id").limit(most)
    known = spark.createDataFrame(rows.toPandas())
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="sqrt").fit(assembler.transform(known.coalesce(1)))
    assert isinstance(forest, RandomForestClassificationModel)
    return PipelineModel([assembler, forest])


def default_forest(spark: SparkSession, words: frozenset[str] = BASE) -> PipelineModel:
    return train(spark.createDataFrame(pd.DataFrame(labelled_findings(words=words), columns=["text", "path", "secret"])), words=words)


def _fitted(docs: DataFrame, text_col: str, forest: PipelineModel | None, words: frozenset[str] | None) -> tuple[PipelineModel, frozenset[str]]:
    """What is not given: words learned from docs, and the forest that goes with them."""
    if words is None:
        words = BASE if forest else learned_words(docs, text_col)
    return forest or default_forest(docs.sparkSession, words), words


def judged(found: DataFrame, forest: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """Candidates with their probability and whether they are secrets."""
    scored = forest.transform(found).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("id", "start", "end", "kind", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def find_secrets(docs: DataFrame, forest: PipelineModel | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5, words: frozenset[str] | None = None) -> DataFrame:
    """id, start, end, kind, probability, is_secret of every candidate. forest, words: with its dictionary (none: BASE); without a forest both are fitted to docs."""
    forest, words = _fitted(docs, text_col, forest, words)
    return judged(scan(docs, id_col, text_col, path_col, words), forest, threshold)


MASK = "[SECRET]"


class Trees:
    """A fitted forest as arrays, for use inside a task."""

    def __init__(self, spark: SparkSession, forest: PipelineModel):
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        forest.stages[-1].write().save(path)
        # a bounded number of nodes: trees times 2 ** depth
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
        rows = rows.select("treeID", "id", "leftChild", "rightChild", "impurityStats", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).orderBy("treeID", "id").collect()
        self.trees = []
        for _, nodes in groupby(rows, key=lambda x: x["treeID"]):
            nodes = list(nodes)
            stats = np.array([x["impurityStats"] for x in nodes])
            self.trees.append((np.array([x["feature"] for x in nodes]), np.array([x["threshold"] or 0.0 for x in nodes]), np.array([x["leftChild"] for x in nodes]), np.array([x["rightChild"] for x in nodes]), stats[:, 1] / stats.sum(axis=1)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(left[node] >= 0)).size:
                at = node[inner]
                node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])
            total += share[node]
        return total / len(self.trees)


def _masked(trees: Trees, words, at: int, path_at: int, threshold: float):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, path in zip(batch.column(at).to_pylist(), batch.column(path_at).to_pylist(), strict=True):
                if found := candidates(text) if text else []:
                    model = pair_model(text)
                    x = np.array([measures(text, str(path or ""), *f, model, words.value) for f in found])
                    for (start, end, *_), p in list(zip(found, trees.probability(x), strict=True))[::-1]:
                        if p >= threshold:
                            text = text[:start] + MASK + text[end:]
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return mask


def redact(docs: DataFrame, forest: PipelineModel | None = None, text_col: str = "text", path_col: str = "source", threshold: float = 0.5, words: frozenset[str] | None = None) -> DataFrame:
    """docs with each secret replaced by MASK, in one pass over the rows once forest and words are there."""
    spark = docs.sparkSession
    forest, words = _fitted(docs, text_col, forest, words)
    trees = Trees(spark, forest)
    # any column names may come: inside, columns go by place
    names, at = docs.columns, [docs.columns.index(c) for c in (text_col, path_col)]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(_masked(trees, spark.sparkContext.broadcast(words), *at, threshold), plain.schema).toDF(*names)


def op2_secret_forest(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", "kind", "probability", "is_secret")
