"""SentencePiece-style unigram encoding and decoding.

A text is normalised as the vocabulary's dummy prefix asks: one blank in front, blanks as the
marker U+2581. Pieces with log scores stand in a double-array trie over UTF-8 bytes. The best
segmentation is the Viterbi path of largest score sum; characters that no piece covers become
byte pieces. Pieces never hold a marker after another character, so a text falls into stretches
that start with a marker run, and each distinct stretch of a batch is segmented once. Stretches of
text without blanks can be long; they are cut where no piece that occurs in them crosses. The parts
walk the trie side by side, position by position; where pieces cross for long, as in runs of one
character, all positions look up their pieces side by side and one pass over these finds the path.

The vocabulary file's scores are merge ranks, not logs: the piece of rank r (from 0, ties by id)
gets the log score -ln(r + 1) - ln(H) of Zipf's law, H the sum of 1 / (r + 1). An unknown
character costs the smallest score less ten; of equal sums the piece that starts first wins.

Decoding turns byte pieces back into bytes, markers into blanks and drops the blank in front, so
decode(encode(text)) == text for every text without U+2581 itself, which reads as a blank.

Defined cases: null stays null (ids and text); an empty text has no ids; each row is encoded for
itself, whatever repeats; ids outside the vocabulary and null ids are skipped when decoding.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import gram, lists, packs, sums
from .tables import narrowed

MARK = "▁".encode()
PACK = 1 << 20  # bytes of text whose stretches are segmented together
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    pieces: list[bytes]  # what each id stands for, b"" for control ids
    score: np.ndarray  # by id
    byte_id: np.ndarray  # id of each byte's piece
    base: np.ndarray  # double array: child of node n by byte b is base[n] + b + 1 where check says n
    check: np.ndarray
    piece_at: np.ndarray  # id of the piece that ends at a node, or -1

    @property
    def unknown(self) -> float:
        return float(self.score.min() - 10)


def double_array(keys: Sequence[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value at node) of a trie over the keys."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, v in keys:
        node = 0
        for b in key:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                value.append(-1)
            node = children[node][b]
        value[node] = v
    # where each node's children stand: nodes with most children first, single children fill the gaps
    used = bytearray(8 * len(children) + 4096)
    base_of, low = [0] * len(children), 258
    for node in sorted((i for i, c in enumerate(children) if c), key=lambda i: -len(children[i])):
        kids = [b + 1 for b in children[node]]
        if len(kids) == 1:
            low = used.index(0, low)
            at = low - kids[0]
        else:
            at, tries = low - min(kids), 0
            while any(used[at + b] for b in kids):
                at, tries = at + 1, tries + 1
            if tries > 200:
                low += 64
        base_of[node] = at
        for b in kids:
            used[at + b] = 1
    size = max(used.rindex(1) + 1, max(base_of) + 258)
    base, check, out, place = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), [0] * len(children)
    for node, kids in enumerate(children):  # a child's number is larger than its parent's
        base[place[node]], out[place[node]] = base_of[node], value[node]
        for b, child in kids.items():
            place[child] = base_of[node] + b + 1
            check[place[child]] = place[node]
    return base, check, out


def load(path: str = MODEL, scores: np.ndarray | None = None) -> Vocabulary:
    """Pieces of a model file; its own segmentation is not used. scores: log scores by id, if at hand; else Zipf's by the file's ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    score = np.array([model.get_score(i) for i in range(n)], np.float32)
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    byte = [model.is_byte(i) for i in range(n)]
    return vocabulary(names, zipf(score) if scores is None else scores, special, byte)


def zipf(ranks: np.ndarray) -> np.ndarray:
    """Log scores of pieces whose stored scores only order them."""
    place = np.empty(len(ranks))
    place[np.argsort(-ranks, kind="stable")] = np.arange(1, len(ranks) + 1)
    return (-np.log(place) - np.log((1 / place).sum())).astype(np.float32)


def vocabulary(names: Sequence[str], score: np.ndarray, special: Sequence[bool], byte: Sequence[bool]) -> Vocabulary:
    pieces, byte_id, keys = [], np.full(256, -1, np.int64), []
    for i, name in enumerate(names):
        if special[i]:
            pieces.append(b"")
        elif byte[i]:
            b = int(name[3:-1], 16)
            byte_id[b] = i
            pieces.append(bytes([b]))
        else:
            pieces.append(name.encode())
            keys.append((pieces[-1], i))
            inner = name.lstrip("▁")
            if "▁" in inner:
                raise ValueError(f"piece {name!r} holds a marker inside")
    if (byte_id < 0).any():
        raise ValueError("byte fallback needs a piece for every byte")
    normal = np.array([not (s or b) for s, b in zip(special, byte, strict=True)])
    score = np.where(normal, score, score[normal].min()).astype(np.float64)
    return Vocabulary(pieces, score, byte_id, *double_array(keys))


def uncrossed(v: Vocabulary, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, stretch) of the parts of stretches between the places that no piece and no character crosses."""
    n = end - start
    where = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    stop = np.repeat(end, n)
    width = np.ones(256, np.int64)
    width[0xC0:0xE0], width[0xE0:0xF0], width[0xF0:] = 2, 3, 4
    lead = (buf[where] & 0xC0) != 0x80
    reach = np.where(lead, np.minimum(width[buf[where]], stop - where), 1)
    # all characters walk the trie side by side; the last piece met is the longest
    go, node, depth = np.flatnonzero(lead), np.zeros(int(lead.sum()), np.int64), 0
    while len(go):
        at = where[go] + depth
        inside = at < stop[go]
        go, node, at = go[inside], node[inside], at[inside]
        nxt = v.base[node] + buf[at].astype(np.int64) + 1
        fits = v.check[nxt] == node
        go, node = go[fits], nxt[fits]
        depth += 1
        hit = go[v.piece_at[node] >= 0]
        reach[hit] = np.maximum(reach[hit], depth)
    here = np.arange(len(where))
    furthest = np.maximum.accumulate(here + reach)
    opens = np.zeros(len(where), bool)
    opens[1:] = lead[1:] & (furthest[:-1] <= here[1:])
    opens[(np.cumsum(n) - n)[n > 0]] = True
    first = np.flatnonzero(opens)
    owner = np.repeat(np.arange(len(n)), n)[first]
    return where[first], where[first] + np.diff(np.append(first, len(where))), owner


def segment(v: Vocabulary, buf: np.ndarray, start: np.ndarray, end: np.ndarray, long: int = 48, at_once: int = 1 << 20, narrow: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all stretches one after the other, how many each has): the best path of each stretch.

    Stretches of more than `long` bytes are cut where no piece crosses, which changes no best path; about at_once bytes go side by side.
    Parts of more than `narrow` bytes go one by one, over the pieces found at all their positions.
    """
    large = np.flatnonzero(end - start > long)
    owner = np.arange(len(start))
    if len(large):
        a, b, of = uncrossed(v, buf, start[large], end[large])
        small = np.flatnonzero(end - start <= long)
        owner = np.concatenate((small, large[of]))
        order = np.argsort(owner, kind="stable")
        owner, low, high = owner[order], np.concatenate((start[small], a))[order], np.concatenate((end[small], b))[order]
    else:
        low, high = start, end
    total, ids, many, i = np.cumsum(high - low), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while i < len(low):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + at_once, "right")))
        size = high[i:j] - low[i:j]
        near, far = np.flatnonzero(size <= narrow), np.flatnonzero(size > narrow)
        x, n = _segment(v, buf, low[i:j][near], high[i:j][near])
        if len(far):
            runs = [_crossed(v, buf[low[i + k] : high[i + k]]) for k in far]
            part = np.concatenate((np.repeat(near, n), np.repeat(far, [len(r) for r in runs])))
            x, n = np.concatenate((x, *runs))[np.argsort(part, kind="stable")], np.bincount(part, minlength=j - i)
        ids.append(x)
        many.append(n)
        i = j
    return np.concatenate(ids), np.bincount(owner, np.concatenate(many), len(start)).astype(np.int64)


def _segment(v: Vocabulary, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `segment`, all stretches position by position."""
    order = np.argsort(start - end, kind="stable")  # longest first: those still going are a prefix
    start, n = start[order], (end - start)[order]
    rows, longest = len(start), int(n.max(initial=0))
    first = np.cumsum(n + 1) - (n + 1)
    best = np.full(int((n + 1).sum()), -np.inf)
    best[first] = 0
    back, via = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
    lead = (buf & 0xC0) != 0x80
    width = np.ones(256, np.int64)
    width[0xC0:0xE0], width[0xE0:0xF0], width[0xF0:] = 2, 3, 4
    unknown = v.unknown
    live = rows
    for i in range(longest):
        live = int(np.searchsorted(-n[:live], -i, "left"))  # stretches longer than i
        at = np.arange(live)
        at = at[lead[start[:live] + i]]
        if not len(at):
            continue
        here = best[first[at] + i]
        covered = np.zeros(len(at), bool)
        whole = np.minimum(width[buf[start[at] + i]], n[at] - i)
        go, node, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        while len(go):
            r = at[go]
            nxt = v.base[node] + buf[start[r] + i + depth].astype(np.int64) + 1
            fits = v.check[nxt] == node
            go, node = go[fits], nxt[fits]
            depth += 1
            ids = v.piece_at[node]
            ends = np.flatnonzero(ids >= 0)
            if len(ends):
                g = go[ends]
                target = first[at[g]] + i + depth
                total = here[g] + v.score[ids[ends]]
                better = total > best[target]
                target, g = target[better], g[better]
                best[target], back[target], via[target] = total[better], i, ids[ends][better]
                covered[go[ends][whole[go[ends]] == depth]] = True
            more = i + depth < n[at[go]]
            go, node = go[more], node[more]
        lost = np.flatnonzero(~covered)
        if len(lost):
            target = first[at[lost]] + i + whole[lost]
            total = here[lost] + unknown
            better = total > best[target]
            target = target[better]
            best[target], back[target], via[target] = total[better], i, -1
    # walk back from the ends, all stretches at once
    pos, going = n.copy(), np.flatnonzero(n > 0)
    steps_row, steps_id, steps_low, steps_high = [], [], [], []
    while len(going):
        t = first[going] + pos[going]
        steps_row.append(going)
        steps_id.append(via[t])
        steps_low.append(back[t])
        steps_high.append(pos[going])
        pos[going] = back[t]
        going = going[pos[going] > 0]
    if not steps_row:
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    row, ids, low, high = (np.concatenate(x) for x in (steps_row, steps_id, steps_low, steps_high))
    many = np.where(ids < 0, high - low, 1)
    row_, low_ = np.repeat(row, many), np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out = np.where(np.repeat(ids, many) < 0, v.byte_id[buf[start[row_] + low_]], np.repeat(ids, many))
    source = order[row_]
    place = np.lexsort((low_, source))
    return out[place].astype(np.int32), np.bincount(source, minlength=rows)


def _found(v: Vocabulary, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id) of all pieces at the characters that start at `at`, by start; a character that is no piece itself has id -1."""
    width = np.ones(256, np.int64)
    width[0xC0:0xE0], width[0xE0:0xF0], width[0xF0:] = 2, 3, 4
    whole = np.minimum(width[buf[at]], len(buf) - at)
    lost = np.ones(len(at), bool)
    go, node, depth, held = np.arange(len(at)), np.zeros(len(at), np.int64), 0, []
    while len(go):
        nxt = v.base[node] + buf[at[go] + depth].astype(np.int64) + 1
        fits = v.check[nxt] == node
        go, node, depth = go[fits], nxt[fits], depth + 1
        hit = v.piece_at[node] >= 0
        held.append((go[hit], at[go[hit]] + depth, v.piece_at[node[hit]].astype(np.int64)))
        lost[go[hit][whole[go[hit]] == depth]] = False
        more = at[go] + depth < len(buf)
        go, node = go[more], node[more]
    held.append((np.flatnonzero(lost), (at + whole)[lost], np.full(int(lost.sum()), -1)))
    which, end, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(which, kind="stable")
    return at[which[order]], end[order], ids[order]


def _crossed(v: Vocabulary, buf: np.ndarray, window: int = 1 << 14) -> np.ndarray:
    """Ids of the best path of one long stretch; pieces are looked up for a window of positions at once."""
    best, back, via = array("d", [-np.inf]) * (len(buf) + 1), array("q", [0]) * (len(buf) + 1), array("i", [-1]) * (len(buf) + 1)
    best[0] = 0.0
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    for i in range(0, len(lead), window):
        start, end, ids = _found(v, buf, lead[i : i + window])
        gain = np.where(ids < 0, v.unknown, v.score[ids])
        for s, e, piece, g in zip(start.tolist(), end.tolist(), ids.tolist(), gain.tolist(), strict=True):
            total = best[s] + g
            if total > best[e]:
                best[e], back[e], via[e] = total, s, piece
    path, at = array("i"), len(buf)
    while at > 0:
        low, piece = back[at], via[at]
        if piece < 0:
            path.extend(v.byte_id[buf[low:at][::-1]].tolist())
        else:
            path.append(piece)
        at = low
    return np.array(path, np.int32)[::-1]


def marked(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as the trie reads them: a marker in front of each that is not empty, and for each blank."""
    n = np.diff(offsets)
    blank = buf == 32
    size = np.where(blank, 3, 1)
    opens = np.zeros(len(buf) + 1, np.int64)
    opens[offsets[:-1][n > 0]] = 3
    place = np.cumsum(size) - size + np.cumsum(opens[:-1])
    total = int(size.sum() + opens.sum())
    out = np.empty(total, np.uint8)
    out[place[~blank]] = buf[~blank]
    for i, b in enumerate(MARK):
        out[place[blank] + i] = b
        out[place[offsets[:-1][n > 0]] - 3 + i] = b
    ends = np.cumsum(np.where(n > 0, np.add.reduceat(np.append(size, 0), np.minimum(offsets[:-1], len(buf))) + 3, 0))
    return out, np.append(0, ends)


def stretches(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the stretches, and how many each text has: each runs from a marker run to the next."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    mark = np.zeros(len(buf), bool)
    mark[:-2] = (buf[:-2] == MARK[0]) & (buf[1:-1] == MARK[1]) & (buf[2:] == MARK[2])
    before = np.zeros(len(buf), bool)
    before[3:] = mark[:-3]
    opens = mark & ~before
    opens[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start = np.flatnonzero(opens)
    return start, np.append(start[1:], len(buf)), np.diff(np.searchsorted(start, offsets))


def encode_pack(v: Vocabulary, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, how many each has)."""
    buf, offsets = marked(buf, offsets)
    start, end, n = stretches(buf, offsets)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(n), np.int64)
    _, index, which = np.unique(gram(sums(buf), start, end), return_index=True, return_inverse=True)
    ids, many = segment(v, buf, start[index], end[index])
    first = (np.cumsum(many) - many)[which]
    size = many[which]
    flat = ids[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    total = np.append(0, np.cumsum(size))
    ends = np.append(0, np.cumsum(n))
    return flat, total[ends[1:]] - total[ends[:-1]]


def decode_pack(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    length = np.fromiter((len(p) for p in v.pieces), np.int64, len(v.pieces))
    start = np.cumsum(length) - length
    data = np.frombuffer(b"".join(v.pieces), np.uint8)
    valid = (ids >= 0) & (ids < len(v.pieces))
    size = np.where(valid, length[np.where(valid, ids, 0)], 0)
    at = np.repeat(np.where(valid, start[np.where(valid, ids, 0)], 0) - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text = data[at].tobytes()
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))].tolist()
    whole = [text[a:b].decode("utf-8", "replace").replace("▁", " ") for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [x[1:] if x.startswith(" ") else x for x in whole]


def _encoded(v: Vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in packs(batches, "text", PACK):
            ids, counts = encode_pack(v, buf, offsets)
            made = lists(ids, counts, pa.int32())
            if rows.column("text").null_count:
                made = pa.compute.if_else(rows.column("text").is_valid(), made, pa.scalar(None, made.type))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in rows.schema.names if c != "text"] + [made], [c for c in rows.schema.names if c != "text"] + ["ids"])

    return encode


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>) of every row."""
    return narrowed(docs, id=id_col, text=text_col).mapInArrow(_encoded(v), f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def _decoded(v: Vocabulary):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 512):
                part = batch.slice(s, 512)
                held = part.column("ids")
                counts = pa.compute.fill_null(pa.compute.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decode_pack(v, pa.compute.fill_null(held.flatten(), -1).to_numpy().astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([t if ok else None for t, ok in zip(texts, held.is_valid().to_pylist(), strict=True)], pa.string())], ["id", "text"])

    return decode


def decode(encoded: DataFrame, v: Vocabulary, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, text of every row."""
    return narrowed(encoded, id=id_col, ids=ids_col).mapInArrow(_decoded(v), f"id {encoded.schema[id_col].dataType.simpleString()}, text string")


def _checked(v: Vocabulary):
    """Digests of the encoding and whether its decoding gives the text back."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte = np.zeros(len(v.pieces), bool)
        byte[v.byte_id] = True
        for rows, buf, offsets in packs(batches, "text", PACK):
            ids, counts = encode_pack(v, buf, offsets)
            at = np.append(0, np.cumsum(counts))
            spelled = np.append(0, np.cumsum(byte[ids]))
            texts = rows.column("text").fill_null("").to_pylist()
            same = [a == b for a, b in zip(decode_pack(v, ids.astype(np.int64), counts), texts, strict=True)]
            shas = [hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(counts), pa.array(spelled[at[1:]] - spelled[at[:-1]]), pa.array(shas), pa.array(same)], ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    return check


def op4_unigram_pieces(spark, sf_dir: str) -> DataFrame:
    docs = narrowed(spark.read.parquet(f"{sf_dir}/documents.parquet"), id="doc_id", text="text")
    return docs.mapInArrow(_checked(load()), "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean").select("*", F.lit(MODEL.rsplit("/", 1)[-1]).alias("vocabulary"))
