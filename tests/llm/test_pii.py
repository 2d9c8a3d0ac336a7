import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pii_offsets as pii
from tests.llm.fixtures import docs, empty, rows

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            luhn = sum(d - 9 if d > 9 else d for d in double) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((*m.span(), kind))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.2@+-() 04", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


CASES = [
    ("write john.doe [at] mail [dot] example dot com now", "john.doe [at] mail [dot] example dot com", "email"),
    ("john at mail dot com.", "john at mail dot com", "email"),
    ("foo at example.com", "foo at example.com", "email"),
    ("mail jоhn@exаmple.com", "jоhn@exаmple.com", "email"),
    ("call plus one five five five two three four five six seven eight now", "plus one five five five two three four five six seven eight", "phone"),
    ("card ４111 1111 1111 1111.", "４111 1111 1111 1111", "card"),
    ("host 192 dot 168 dot 0 dot 1 up", "192 dot 168 dot 0 dot 1", "ip"),
    ("j​o@e​x.com", "j​o@e​x.com", "email"),
]


@pytest.mark.parametrize("text,span,kind", CASES)
def test_hidden_spans_map_back(text, span, kind):
    assert [(text[s:e], k) for s, e, k in pii.hidden_spans(text, pii.base_spans(text))] == [(span, kind)]


@pytest.mark.parametrize("text", ["see me at home.Then at noon", "a one two punch", "dot and at", "un deux jours", "he is at a.b"])
def test_clean_text_has_none(text):
    assert not pii.hidden_spans(text, pii.base_spans(text))


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "a@" * 60_000, "one " * 30_000, "+1" * 60_000, "1." * 60_000, "a at " * 30_000])
def test_long_texts_take_linear_time(text):
    start = time.time()
    pii.hidden_spans(text, pii.base_spans(text))
    assert time.time() - start < 20


def test_rows_and_digests(spark):
    out = pii.find_pii(docs(spark)).mapInArrow(pii._digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows())
    for r in rows():
        base = plain(r[1] or "")
        assert (got[r[0]].n_email, got[r[0]].n_card) == (sum(k == "email" for _, _, k in base), sum(k == "card" for _, _, k in base))
        assert got[r[0]].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    assert pii.find_pii(empty(spark)).count() == 0
