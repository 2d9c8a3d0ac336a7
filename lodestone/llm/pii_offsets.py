"""Personal data with offset-preserving deobfuscation.

Base spans come from four patterns on the source text. Then two transducers rewrite what hides an
identifier: the first maps lookalike characters to ASCII and drops invisible ones, the second
turns spelled digits into digits and at/dot disguises into '@' and '.'. A transducer's output is
a list of edits against its input, so every character of the rewritten text knows the stretch of
source it came from: the same patterns run on the rewritten text, and what they find there and
not in the source goes back to source offsets.

Offsets are code points, ends exclusive. Every pattern is linear in the text's length.

Defined cases: null and empty texts have no spans; each row gives one row, whatever repeats; of
overlapping spans of one kind the base one stays; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import narrowed

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# a failed start inside a run of digits fails for the whole run, so a match starts where a run does
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and not _NOT_LOCAL.match(text, low - 1):
            low -= 1
        found = _DOMAIN.match(text, at + 1) if low < at else None
        if found:
            done = found.end()
            yield low, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return (sum(map(int, digits[-1::-2])) + sum(int(twice[int(d)]) for d in digits[-2::-2])) % 10 == 0


def _ips(text: str) -> Iterator[Span]:
    if "." not in text:
        return
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterable[Span]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}

# Letters that look like ASCII ones, and characters that show nothing.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "з": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ո": "n", "ս": "u", "օ": "o", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ", "＠": "@", "﹫": "@",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u200e\u200f"
# compatibility forms of ASCII: full width, styled mathematical, circled, super- and subscript
_STYLED = "！-～\U0001d400-\U0001d7ff①-⑨⓪Ⓐ-ⓩ⁰-⁹₀-₉²³¹٠-٩۰-۹०-९"
_LOOK = re.compile("[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + _STYLED + "]")

# Digits spelled in the languages of the corpus.
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
# three digits in a row or more, one of them spelled: lone number words are prose
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?P<plus>plus)[\x20-]{{1,2}})?(?:{_WORD}|[0-9]+)(?:[\x20,.-]{{1,2}}(?:{_WORD}|[0-9]+)(?!\w)){{2,}}", re.I)
_SPELLED_ONE = re.compile(rf"(?<!\w){_WORD}(?!\w)", re.I)
# where a disguised or plain at-sign may begin
_STARTS = ("@", " at ", "_at_", "[at", "(at", "{at", "<at", "[ at", "( at", "{ at", "< at")
# a disguised sign: bracketed anywhere, or a lone word between blanks
_AT_SIGN = r"(?:[\x20]?[\[({<][\x20]?(?:at|@)[\x20]?[\])}>][\x20]?|[\x20](?:at|@)[\x20]|[\x20]?_at_[\x20]?|[\x20]@|@[\x20])"
_DOT_SIGN = r"(?:[\x20]?[\[({<][\x20]?(?:dot|\.)[\x20]?[\])}>][\x20]?|[\x20](?:dot)[\x20]|[\x20]?_dot_[\x20]?|[\x20]\.[\x20])"
_DOT = re.compile(_DOT_SIGN, re.I)
# Endings that make a lone `at` before a plain domain a disguise.
ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|ch|at|be|nl|it|us|ca|dev|app|example|test"
_LABEL = "[A-Za-z0-9-]{1,63}"
_HOST = re.compile(rf"(?P<at>@|{_AT_SIGN})(?P<host>{_LABEL}(?:(?:\.|{_DOT_SIGN}){_LABEL}){{1,8}})(?![A-Za-z0-9-])", re.I)
_PLAIN = re.compile(rf"(?:{_LABEL}\.)+(?:{ENDINGS})$", re.I)
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOT_SIGN})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)

Edit = tuple[int, int, str]


class Rewritten:
    """A text after edits; any stretch of it leads back to the text before."""

    def __init__(self, before: str, edits: list[Edit]):
        pieces, self.at, self.from_, self.edits, done, size = [], [0], [(0, False, 0)], [], 0, 0
        for start, end, new in edits:
            if start < done:
                continue
            for source, stop, piece, edited in ((done, start, before[done:start], False), (start, end, new, True)):
                if piece:
                    self.at.append(size)
                    self.from_.append((source, edited, stop))
                    pieces.append(piece)
                if edited:
                    self.edits.append((size, size + len(piece)))
                size += len(piece)
            done = end
        self.at.append(size)
        self.from_.append((done, False, len(before)))
        pieces.append(before[done:])
        self.text = "".join(pieces)

    def back(self, start: int, end: int) -> Span:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        low, edited, _ = self.from_[i]
        high, cut, stop = self.from_[j]
        return low if edited else low + start - self.at[i], stop if cut else high + end - self.at[j]

    def touched(self, start: int, end: int) -> bool:
        i = bisect_right(self.edits, (start, start))
        return any(lo < end and hi >= start for lo, hi in self.edits[max(0, i - 1) : i + 1])


def lookalike_edits(text: str) -> list[Edit]:
    if text.isascii():
        return []
    plain = lambda c: "" if c in INVISIBLE else LOOKALIKES.get(c) or _compatible(c)
    return [(m.start(), m.end(), plain(m[0])) for m in _LOOK.finditer(text)]


def _compatible(c: str) -> str:
    digit = unicodedata.digit(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


def _spells(low: str) -> bool:
    """Whether some word is a spelled digit and the next one a digit or a spelled one."""
    parts = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    spelled = [i for i, w in enumerate(parts) if w in SPELLED]
    digits = lambda i: 0 <= i < len(parts) and (parts[i] in SPELLED or parts[i].isdigit())
    return any(digits(i - 1) or digits(i + 1) for i in spelled)


def _signs(text: str, low: str) -> Iterator[re.Match]:
    places = set()
    for start in _STARTS:
        at = low.find(start)
        while at >= 0:
            places.add(at - 1 if at and start[0] != " " and text[at - 1] == " " else at)
            at = low.find(start, at + 1)
    done = 0
    for at in sorted(places):
        if at >= done and (m := _HOST.match(text, at) or _HOST.match(text, at + 1)):
            done = m.end()
            yield m


def disguise_edits(text: str) -> list[Edit]:
    """Spelled digits in runs, and signs inside what reads as an address once they are undone."""
    low, edits = text.lower(), []
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    if _spells(low):
        for run in _SPELLED_RUN.finditer(text):
            words = list(_SPELLED_ONE.finditer(run[0]))
            if not words:
                continue
            base = run.start()
            if run["plus"]:
                edits.append((run.start("plus"), run.end("plus") + 1, "+"))
            last = None
            for m in re.finditer(rf"{_WORD}|[0-9]+", run[0][len(run["plus"] or "") :], re.I):
                start, end = base + len(run["plus"] or "") + m.start(), base + len(run["plus"] or "") + m.end()
                if last is not None and text[last:start] not in (" ", "-"):
                    edits.append((last, start, " "))
                if not m[0].isdigit():
                    edits.append((start, end, str(SPELLED[m[0].lower()])))
                last = end
    for m in _signs(text, low):
        at, host = m["at"], m["host"]
        if not m.start() or _NOT_LOCAL.match(text, m.start() - 1):
            continue
        signs = list(_DOT.finditer(host))
        # a bare `at` or a spaced sign before a plain domain needs a known ending
        if not signs and (at == "@" or at.strip().lower() in ("at", "@") and not _PLAIN.match(host)):
            continue
        if at != "@":
            edits.append((*m.span("at"), "@"))
        edits += [(m.start("host") + s.start(), m.start("host") + s.end(), ".") for s in signs]
    if "dot" in low or "[.]" in low or "(.)" in low:
        for m in _DOTTED.finditer(text):
            edits += [(m.start() + s.start(), m.start() + s.end(), ".") for s in _DOT.finditer(m[0])]
    return sorted(edits)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    kinds = KINDS if _DIGITS.search(text) else KINDS[:1]
    return [(s, e, kind) for kind in kinds for s, e in FINDERS[kind](text)]


def hidden_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that only the rewritten text shows, in source offsets; none overlaps a base span of its kind."""
    first = Rewritten(text, lookalike_edits(text))
    second = Rewritten(first.text, disguise_edits(first.text))
    if not first.edits and not second.edits:
        return []
    taken = {kind: sorted((s, e) for s, e, k in base if k == kind) for kind in KINDS}
    found = []
    for kind in KINDS:
        for s, e in FINDERS[kind](second.text):
            mid = second.back(s, e)
            if not (second.touched(s, e) or first.touched(*mid)):
                continue
            s, e = first.back(*mid)
            i = bisect_right(taken[kind], (s, len(text)))
            if all(hi <= s or lo >= e for lo, hi in taken[kind][max(0, i - 1) : i + 1]):
                found.append((s, e, kind))
    return found


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, with commas."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


SPANS = "array<struct<start:int,end:int,kind:string,hidden:boolean>>"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("hidden", pa.bool_())]))
    for batch in batches:
        out = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            out.append([{"start": s, "end": e, "kind": k, "hidden": h} for h, spans in ((False, base), (True, hidden_spans(text, base))) for s, e, k in spans])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], ["id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and its spans (start, end, kind, hidden) of every row."""
    return narrowed(docs, id=id_col, text=text_col).mapInArrow(_marked, f"id {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for spans in batch.column("spans").to_pylist():
            every = [(x["start"], x["end"], x["kind"]) for x in spans]
            base = [s for s, x in zip(every, spans, strict=True) if not x["hidden"]]
            counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_hidden"])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.mapInArrow(_digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long")
