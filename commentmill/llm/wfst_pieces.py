"""SentencePiece encoding and decoding with weighted finite-state transducers.

The pieces are compiled into a transducer: a trie whose final arcs emit a piece at the cost of its
negated score, and whose states remember the piece emitted last. A text is composed with it arc by
arc, and the tropical-semiring shortest path through the composition is its encoding. The normaliser
is the identity rule (a mark before the text, spaces written as marks), done as plain replacement, and
a model with another rule is refused. Byte fallback is one more arc of the search: a character that no
piece covers becomes its UTF-8 bytes. Where equal scores close every path, the stretch is merged as it
stands.

For vocabularies learned by merging pairs, two pieces may only follow one another if merging their
joined text leaves the cut between them; all other arcs have infinite weight. That leaves the
encoding that merging in order of score gives. For unigram vocabularies all arcs are open
(``paired=False``).

The composition falls apart where no piece can cross: before a mark that follows another character,
and around characters that fall back to bytes. The stretches between are solved one by one, and
short ones are remembered.

Defined cases: null and empty texts have no pieces; the mark U+2581 itself decodes to a space;
bytes that are no UTF-8 decode to U+FFFD; unknown ids in a decoding raise; a null id or repeated
rows are carried as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches up to this many characters are remembered, twice so many at most.
SHORT, REMEMBERED = 32, 200_000
#: Bytes of the texts that are encoded together (or one text).
BATCH_BYTES = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """What the transducers are compiled from: it is small and travels with the tasks."""
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # id of each byte's piece
    special: frozenset[int]  # control and unknown: no arc emits them
    unknown: int
    paired: bool = True


def load_vocabulary(path: str = MODEL, paired: bool = True) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    _refuse_other_rules(sp.serialized_model_proto(), path)
    ids = range(sp.vocab_size())
    pieces = [sp.id_to_piece(i) for i in ids]
    by_text = {p: i for i, p in enumerate(pieces) if sp.is_byte(i)}
    special = frozenset(i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    return Vocabulary(pieces, [sp.get_score(i) for i in ids],
                      [by_text.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)], special, sp.unk_id(), paired)


def _refuse_other_rules(model: bytes, path: str) -> None:
    from sentencepiece import sentencepiece_model_pb2

    rule = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec
    if rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
        raise ValueError(f"{path}: only the identity rule with a mark before the text is built, not {rule.name!r}")


class Transducer:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        silent = vocab.special | set(vocab.byte_ids)
        # a state is its outgoing arcs by character and the piece it emits (-1: none)
        self.start: dict[str, list] = {}
        self.by_text: dict[str, int] = {}
        for i, piece in enumerate(vocab.pieces):
            if i in silent:
                continue
            self.by_text[piece] = i
            arcs, state = self.start, None
            for ch in piece:
                state = arcs.get(ch)
                if state is None:
                    state = arcs[ch] = [{}, -1]
                arcs = state[0]
            state[1] = i
        self.cost = [-s for s in vocab.scores]
        self.bytes_cost = max(self.cost) + 1.0
        self.width = len(vocab.pieces)
        self.pairs: dict[int, bool] = {}  # by a * width + b
        self.emitted = [p.replace(MARK, " ").encode() for p in vocab.pieces]
        for i in vocab.special:
            self.emitted[i] = b""
        for b, i in enumerate(vocab.byte_ids):
            self.emitted[i] = bytes([b])
        if vocab.unknown in vocab.byte_ids:
            self.emitted[vocab.unknown] = " ⁇ ".encode()
        self.inside = {p[i:i + 2] for p in self.by_text for i in range(len(p) - 1)}
        crossing = any(MARK in p.lstrip(MARK) for p in self.by_text)
        self.stretch = re.compile(r"(?s).+" if crossing else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+"
                                  if "\n" not in self.by_text else f"(?s){MARK}+[^{MARK}]*|[^{MARK}]+")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.by_text.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.cost[piece] < best):
                    best, at = self.cost[piece], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the arc of piece b is open in the state after piece a."""
        left, right = self.vocab.pieces[a], self.vocab.pieces[b]
        known = not self.vocab.paired or self.merged(left + right) == [left, right]
        self.pairs[a * self.width + b] = known
        return known

    def shortest(self, text: str) -> list[int]:
        """The ids on the cheapest path of the composition with one stretch of normalised text,
        relaxed from left to right. A position keeps its cheapest path; where pairs are closed
        there is one open path to a position, so nothing is lost."""
        n = len(text)
        start, cost, pairs, width = self.start, self.cost, self.pairs, self.width
        infinite = float("inf")
        total = [0.0] + [infinite] * n
        piece, before = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            so_far = total[i]
            if so_far == infinite:
                continue
            last, arcs, j = piece[i], start, i
            for ch in text[i:]:
                state = arcs.get(ch)
                if state is None:
                    break
                arcs, arc = state
                j += 1
                if arc >= 0 and so_far + cost[arc] < total[j]:
                    if last >= 0:
                        open_ = pairs.get(last * width + arc)
                        if not (self.may_follow(last, arc) if open_ is None else open_):
                            continue
                    total[j], piece[j], before[j] = so_far + cost[arc], arc, i
            if text[i] not in self.by_text:  # byte fallback
                total[i + 1], piece[i + 1], before[i + 1] = so_far + self.bytes_cost, -1, i
        if total[n] == infinite:  # equal scores can close every path: merge as it stands
            return [i for p in self.merged(text) for i in
                    ([self.by_text[p]] if p in self.by_text else self.as_bytes(p))]
        out: list[int] = []
        at = n
        while at > 0:
            out.extend([piece[at]] if piece[at] >= 0 else reversed(self.as_bytes(text[before[at]:at])))
            at = before[at]
        out.reverse()
        return out

    def as_bytes(self, text: str) -> list[int]:
        return [self.vocab.byte_ids[b] for b in text.encode("utf-8", "replace")]

    def uncrossed(self, text: str) -> list[str]:
        """Parts of a stretch between neighbours that no piece holds side by side. Where letters
        meet they are not looked for: cutting only saves work."""
        if text[1:].isalpha():
            return [text]
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.inside]
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def normalised(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.emitted.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Remembered(dict):
    """Ids by stretch, as bytes of 32-bit numbers; short ones are kept. When it is full,
    what it holds becomes the older half, and what is used again comes back."""

    def __init__(self, solve, most: int):
        self.solve, self.most = solve, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            out = self.solve(text)
        if len(text) <= SHORT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = out
        return out


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.transducer = t = Transducer(vocab)
        self.known = _Remembered(self._solve, REMEMBERED)

    def _solve(self, stretch: str) -> bytes:
        parts = self.transducer.uncrossed(stretch)
        if len(parts) > 1:
            return b"".join(map(self.known.__getitem__, parts))
        return array("i", self.transducer.shortest(stretch)).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        t = self.transducer
        raw = b"".join(map(self.known.__getitem__, t.stretch.findall(t.normalised(text or ""))))
        return np.frombuffer(raw, np.int32)


def _encoder(vocab: Vocabulary) -> Encoder:
    """The encoder of this Python worker. Workers outlive tasks, but functions that travel by value
    bring new globals with each task; a module of the worker keeps what was compiled and learned."""
    kept = sys.modules.setdefault("__piece_encoders__", types.ModuleType("__piece_encoders__")).__dict__
    key = hashlib.blake2b(repr((vocab.pieces, vocab.scores, vocab.paired)).encode()).hexdigest()
    if key not in kept:
        kept[key] = Encoder(vocab)
    return kept[key]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of bytes of text (or one row)."""
    sizes = [n or 0 for n in pc.binary_length(batch.column("text")).to_pylist()]
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def encode(df: DataFrame, vocab: Vocabulary, text_col: str = "text", carry: list[str] | None = None,
           verify: str | None = None) -> DataFrame:
    """The carried columns (all but the text's, by default) of each row, and ``ids``. With
    ``verify`` a column of that name tells whether the decoded ids give the text again (marks in it
    read as spaces)."""
    carry = [c for c in df.columns if c != text_col] if carry is None else carry
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    plain = df.select(F.struct(*carry).alias("row"), F.col(text_col).cast("string").alias("text"))
    names = ["row", "ids", *([verify] if verify else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab)
        back = encoder.transducer.decode
        for whole in batches:
            for batch in _slices(whole):
                texts = batch.column("text").to_pylist()
                ids = [encoder(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                out = [batch.column("row"), pa.ListArray.from_arrays(pa.array(ends), values)]
                if verify:
                    out.append(pa.array([back(i.tolist()) == (t or "").replace(MARK, " ")
                                         for i, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names)

    row = "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in carry) + ">"
    schema = f"row {row}, ids array<int>" + (f", `{verify}` boolean" if verify else "")
    return plain.mapInArrow(run, schema).select("row.*", *names[1:])


def decode(df: DataFrame, vocab: Vocabulary, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of its ids in column ``out``, which replaces one of that name."""
    carry = [c for c in df.columns if c != out]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    plain = df.select(F.struct(*carry).alias("row"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _encoder(vocab).transducer
        for batch in batches:
            at = batch.column("ids")
            texts = [transducer.decode(at[i].as_py() or []) for i in range(len(at))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", out])

    row = "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in carry) + ">"
    return plain.mapInArrow(run, f"row {row}, `{out}` string").select("row.*", out)
