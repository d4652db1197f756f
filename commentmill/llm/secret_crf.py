"""Secrets by a linear-chain conditional random field over tokens.

Base patterns find assignments, access keys and hexadecimal runs; what they find always stays. A
chain with the labels B, I and O (secret begin, inside, outside) reads the tokens of a text: runs of
word characters, and single other characters. Its features are the token's shape, the shapes of the
tokens before and after, hashed neighbouring words, and features of the whole file. The best label
sequence is found by Viterbi; spans that touch no base span are added.

The chain learns from windows of a bounded sample of the given documents, labelled by the base
patterns; a quarter of the windows hide the neighbouring words, so that shapes alone can tell.
Windows around odd-looking tokens outside base spans are the negative examples. Scores are
weighed so that a token must be clearly likelier inside a secret than outside (``CAUTION``).

Decoding is exact. A token whose O is ahead by more than all transitions around it can make up for
is O in every best sequence; Viterbi runs over the stretches between such tokens.

Defined cases: null and empty texts have no spans; equal texts give equal spans; with too few
examples nothing is added to the base spans; an empty table gives an empty result. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentmill.llm.common import map_texts

KINDS = ("assign", "access", "hex")
ADDED = "crf"
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
#: Most documents looked at and windows learned from, tokens per window, and rounds of training.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW, ROUNDS = 20_000, 1_500, 33, 60
CAUTION = 2.0
LEAST_CHARS = 12

Span = tuple[str, int, int]

_ASSIGN = re.compile(r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[Span]:
    """By start, then kind; per kind leftmost matches that do not overlap."""
    out = [(s, 0, e) for s, e, v in _assigned(text) if v]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def _assigned(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _ASSIGN.finditer(text):
        yield m.start(), m.end(), m.start(1) if len(m[1]) >= 12 else 0


def _values(text: str) -> list[tuple[int, int]]:
    """What of the base spans is the secret itself."""
    out = [(v, e) for _, e, v in _assigned(text) if v]
    out += [m.span() for p in (_ACCESS, _HEX) for m in p.finditer(text)]
    return out


# classes of bytes: 0 white space, 1 word characters (and all of non-ASCII), 2 others
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[128:] = 1
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/.-":
    _CLASS[_c] = 1
_DIGIT, _UPPER, _HEXLOW, _LOWER, _MARKS = (np.zeros(256, np.uint8) for _ in range(5))
_DIGIT[48:58] = 1
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_HEXLOW[48:58] = _HEXLOW[97:103] = 1
for _c in b"_+/.-":
    _MARKS[_c] = 1
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_PLACES = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

LENGTHS = np.array([1, 2, 4, 7, 11, 15, 23, 39])
SHAPES, WORDS, FILES = 8 * 32 + 1, 1024, 16
#: Offsets of the feature groups: own, previous and next shape, words 1 to 4 before and 1 after, file.
_GROUPS = np.cumsum([0, SHAPES, SHAPES, SHAPES, WORDS, WORDS, WORDS, WORDS, WORDS, FILES])
SIZE = int(_GROUPS[-1])
_SHAPE_COLS, _WORD_COLS = (0, 1, 2), (3, 4, 5, 6, 7)


@dataclass
class Tokens:
    start: np.ndarray  # bytes
    end: np.ndarray
    features: np.ndarray  # one line of feature numbers per token


def tokenize(data: bytes) -> Tokens | None:
    """Tokens of one text with their features, by whole-array operations."""
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    if not kind.any():
        return None
    edge = np.empty(len(raw), bool)
    edge[0] = True
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    first = np.nonzero(edge)[0]
    stop = np.append(first[1:], len(raw))
    keep = kind[first] > 0
    n = stop - first

    def count(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[raw], first, dtype=np.int64)[keep]

    place = np.arange(len(raw)) - np.repeat(first, n)
    coded = (_FOLD[raw] + np.uint64(1)) * _PLACES[place & 63]
    words = np.add.reduceat(coded, first)[keep]
    words = (((words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % WORDS
    start, end = first[keep], stop[keep]
    n = end - start
    digits, upper, lower, low, marks = (count(t) for t in (_DIGIT, _UPPER, _LOWER, _HEXLOW, _MARKS))
    shape = np.searchsorted(LENGTHS, n, side="right") - 1
    mix = ((digits > 0) * 1 + (upper > 0) * 2 + (lower > 0) * 4 + (marks > 0) * 8 + (low == n) * 16)
    shape = shape * 32 + mix
    density = min(3, int(20 * (kind == 2).sum() / len(raw))) * 4 + min(3, int(40 * digits.sum() / len(raw)))

    def moved(values: np.ndarray, by: int, empty: int) -> np.ndarray:
        out = np.full(len(values), empty, np.int64)
        if by > 0:
            out[by:] = values[:-by]
        else:
            out[:by] = values[-by:]
        return out

    cols = [shape, moved(shape, 1, SHAPES - 1), moved(shape, -1, SHAPES - 1),
            *[moved(words, k, 0) for k in (1, 2, 3, 4, -1)], np.full(len(shape), density)]
    return Tokens(start, end, np.stack(cols, axis=1) + _GROUPS[:-1])


@dataclass
class Chain:
    weights: np.ndarray  # SIZE x 3
    moves: np.ndarray  # 3 x 3, from the label of a token to that of the next

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for c in range(features.shape[1]):
            out += self.weights[features[:, c]]
        out[:, O] += CAUTION
        return out


#: I never follows O, nor comes first.
_CLOSED = np.zeros((3, 3))
_CLOSED[O, I] = -np.inf


def viterbi(chain: Chain, e: np.ndarray, before: int = O, after: int | None = None) -> list[int]:
    """Best labels of a stretch that stands after label ``before`` and ahead of ``after``."""
    moves = (chain.moves + _CLOSED).tolist()
    score = [moves[before][y] + e[0][y] for y in range(3)]
    back: list[list[int]] = []
    for row in e[1:].tolist():
        step = [max(range(3), key=lambda p, y=y: score[p] + moves[p][y]) for y in range(3)]
        score = [score[step[y]] + moves[step[y]][y] + row[y] for y in range(3)]
        back.append(step)
    if after is not None:
        score = [score[y] + moves[y][after] for y in range(3)]
    y = max(range(3), key=score.__getitem__)
    out = [y]
    for step in reversed(back):
        y = step[y]
        out.append(y)
    return out[::-1]


def decode(chain: Chain, e: np.ndarray) -> np.ndarray:
    """Best labels of a whole text."""
    labels = np.full(len(e), O)
    spread = 4 * float(chain.moves.max() - chain.moves.min())
    forced = np.zeros(len(e))
    forced[:-1] = np.maximum(0, e[1:, I] - e[1:, B])  # an I after it would have to become B
    unsure = e[:, O] - np.maximum(e[:, B], e[:, I]) <= spread + forced
    rows = np.nonzero(unsure)[0]
    if not len(rows):
        return labels
    for part in np.split(rows, np.nonzero(np.diff(rows) > 1)[0] + 1):
        a, b = int(part[0]), int(part[-1]) + 1
        labels[a:b] = viterbi(chain, e[a:b], O, O if b < len(e) else None)
    return labels


def learn(features: np.ndarray, labels: np.ndarray, real: np.ndarray) -> Chain:
    """Maximum likelihood (with a small ridge) by adaptive gradient steps over windows of equal
    length: features w x t x columns, labels w x t, real w x t (False: padding)."""
    w, t, _ = features.shape
    chain = Chain(np.zeros((SIZE, 3)), np.zeros((3, 3)))
    seen_w, seen_m = np.full((SIZE, 3), 1e-6), np.full((3, 3), 1e-6)
    flat = features.reshape(-1, features.shape[2])
    mask = real[:, :, None]
    goal = np.eye(3)[labels] * mask
    for _ in range(ROUNDS):
        e = np.zeros((len(flat), 3))
        for c in range(flat.shape[1]):
            e += chain.weights[flat[:, c]]
        e = e.reshape(w, t, 3)
        moves = chain.moves + _CLOSED
        with np.errstate(divide="ignore"):
            alpha, beta = np.empty((w, t, 3)), np.zeros((w, t, 3))
            alpha[:, 0] = e[:, 0] + moves[O]
            for i in range(1, t):
                nxt = np.logaddexp.reduce(alpha[:, i - 1, :, None] + moves, axis=1) + e[:, i]
                alpha[:, i] = np.where(mask[:, i], nxt, alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                prv = np.logaddexp.reduce(moves + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
                beta[:, i] = np.where(mask[:, i + 1], prv, beta[:, i + 1])
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)[:, None, None]
            p = np.exp(alpha + beta - z) * mask
            both = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[..., None])
        both = both * mask[:, 1:, :, None]
        diff = (goal - p).reshape(-1, 3)
        g = np.zeros((SIZE, 3))
        for y in range(3):
            for c in range(flat.shape[1]):
                g[:, y] += np.bincount(flat[:, c], diff[:, y], SIZE)
        held = (goal[:, :-1, :, None] * goal[:, 1:, None, :]).sum((0, 1))
        m = held - both.sum((0, 1))
        g = g - 0.05 * chain.weights
        seen_w += g * g
        seen_m += m * m
        chain.weights += 0.5 * g / np.sqrt(seen_w)
        chain.moves += 0.5 * np.where(np.isfinite(_CLOSED), m / np.sqrt(seen_m), 0)
    return chain


def windows(text: str, code: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature and label windows of a text for training, some with groups of features hidden."""
    data = text.encode("utf-8", "replace")
    tokens = tokenize(data)
    if tokens is None:
        return []
    labels = np.full(len(tokens.start), O)
    for s, e in _values(text):
        a, b = len(text[:s].encode("utf-8", "replace")), len(text[:e].encode("utf-8", "replace"))
        inside = np.nonzero((tokens.start < b) & (tokens.end > a))[0]
        if len(inside):
            labels[inside[1:]] = I
            labels[inside[0]] = B
    draw = np.random.Generator(np.random.PCG64(code))
    n = len(labels)
    good = np.nonzero(labels == B)[0][:4]
    shape = tokens.features[:, 0]
    odd = np.nonzero((labels == O) & (tokens.end - tokens.start >= 7) & (shape % 2 == 1))[0]
    picks = [*good, *(draw.choice(odd, min(3, len(odd)), replace=False) if len(odd) else [])]
    if not picks and code % 16 == 0:
        picks = [int(draw.integers(n))]
    out = []
    for at in picks:
        a = max(0, min(int(at) - WINDOW // 2, n - WINDOW))
        f, y = tokens.features[a:a + WINDOW].copy(), labels[a:a + WINDOW]
        hide = int(draw.integers(4))
        if hide == 0:
            for c in _WORD_COLS:
                f[:, c] = _GROUPS[c]
        out.append((f, y))
    return out


def train(docs: DataFrame, text_col: str) -> Chain | None:
    """From windows of at most SAMPLE_DOCS documents (in expectation), SAMPLE_WINDOWS in all."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    drawn = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def learn_from(text: str | None) -> dict:
        code = int(hashlib.md5((text or "").encode("utf-8", "replace")).hexdigest()[:12], 16)
        return {"code": code, "rows": [{"f": f.ravel().astype(np.int32), "y": y.astype(np.int32)}
                                       for f, y in windows(text or "", code)]}

    kind = "struct<code:bigint,rows:array<struct<f:array<int>,y:array<int>>>>"
    found = (map_texts(drawn, text_col, text_col, lambda: learn_from, "e", kind)
             .select("e.code", F.posexplode("e.rows").alias("i", "r")).select("code", "i", "r.f", "r.y")
             .dropDuplicates(["code", "i"]).orderBy("code", "i").limit(SAMPLE_WINDOWS).toPandas())
    if sum(B in y for y in found["y"]) < 10:
        return None
    w, cols = len(found), len(_GROUPS) - 1
    features = np.tile(_GROUPS[:-1], (w, WINDOW, 1))
    labels, real = np.full((w, WINDOW), O), np.zeros((w, WINDOW), bool)
    for i, (f, y) in enumerate(zip(found["f"], found["y"], strict=True)):
        features[i, :len(y)] = np.asarray(f).reshape(-1, cols)
        labels[i, :len(y)] = y
        real[i, :len(y)] = True
    return learn(features, labels, real)


def added_spans(text: str, base: list[Span], chain: Chain) -> list[Span]:
    """Decoded spans of LEAST_CHARS characters or more that touch no base span."""
    data = text.encode("utf-8", "replace")
    tokens = tokenize(data)
    if tokens is None:
        return []
    labels = decode(chain, chain.emissions(tokens.features))
    out: list[Span] = []
    for at in np.nonzero(labels == B)[0]:
        stop = at
        while stop + 1 < len(labels) and labels[stop + 1] == I:
            stop += 1
        start = len(data[:tokens.start[at]].decode("utf-8", "replace"))
        end = start + len(data[tokens.start[at]:tokens.end[stop]].decode("utf-8", "replace"))
        if end - start >= LEAST_CHARS and not any(start < e and s < end for _, s, e in base):
            out.append((ADDED, start, end))
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, spans (array of kind, start, end, base)."""
    chain = train(df, text_col)

    def spans(text: str | None) -> list[dict]:
        base = base_spans(text or "")
        more = added_spans(text, base, chain) if chain and text else []
        both = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in more]
        return [{"kind": k, "start": s, "end": e, "base": b}
                for k, s, e, b in sorted(both, key=lambda x: (x[1], (*KINDS, ADDED).index(x[0])))]

    return map_texts(df, id_col, text_col, lambda: spans, "spans", SPANS).withColumnRenamed("id", id_col)
