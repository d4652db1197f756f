"""Personal data by candidates and gradient boosting.

Base patterns find mail addresses, IP addresses, card and phone numbers; what they find always
stays. High-recall generators propose more spans, which may overlap: anything around an at sign,
spelled-out addresses, runs of digits, dotted (also spaced or bracketed dots) and colon-separated
groups (IPv6 and MAC addresses). Boosted trees score each
candidate by its format and its context, a threshold per shape is calibrated for precision on
documents kept aside, and candidates above it that touch no base span are added.

The trees learn from all given documents, equal texts once: candidates that coincide with a base
span are positive, others negative. Each positive is also shown rewritten in ways that base patterns
miss (without the plus, spelled out, other separators, a host without a dot, an IP address as IPv6,
MAC or with spaced dots), and each with a near miss of the same shape (a broken check digit, a date,
a version, a clock time), so that format and context decide, not the base pattern. A shape is only
learned where the documents hold base spans of its kind: IPv6 and MAC addresses need IP addresses.

Defined cases: null and empty texts have no spans; equal texts give equal spans; with too few
examples, or where no threshold is precise enough, nothing is added to the base spans; an empty
table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentmill.llm.common import map_texts, materialized
from commentmill.operators.linear import _added

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
#: A fifth of the documents calibrates. Distinct lines that one task adds up, and steps of a score.
FOLDS, LINES_PER_TASK, STEPS = 5, 50_000, 1 << 14
PRECISION = 0.99
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
INNER = 2 ** DEPTH - 1

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin at the first digit of a run, so later digits are not tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """By kind, then start; per kind leftmost matches that do not overlap."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


SHAPES = ("mail", "spelled", "number", "groups", "colons")
_SPELLED = re.compile(r"(?i)\b[\w.+-]{1,64} ?[\[(]? ?at ?[\])]? ?[\w-]{1,64} ?[\[(]? ?dot ?[\])]? ?[a-z]{2,10}\b")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}")
_GROUPS = re.compile(r"[0-9]{1,4}(?:(?: ?[.,_] ?|\[\.\])[0-9]{1,4}){3,}")
_COLONS = re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){1,6}(?::[0-9A-Fa-f]{1,4}|::)(?!\w|:[0-9A-Fa-f])")
_BREAK = re.compile(r"[\s<>\"'(),;]")


def candidates(text: str) -> list[Span]:
    """Overlapping spans by shape; recall matters, not precision."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and at - start < 80 and not _BREAK.match(text[start - 1]):
            start -= 1
        m = _BREAK.search(text, at + 1, at + 120)
        stop = m.start() if m else min(len(text), at + 120)
        while stop > at + 1 and text[stop - 1] in ".:!?":  # the sentence's, not the address's
            stop -= 1
        if start < at and stop > at + 1:
            out.append(("mail", start, stop))
        at = text.find("@", at + 1)
    if "dot" in text or "DOT" in text or "Dot" in text:
        out += [("spelled", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    for shape, pattern in (("number", _NUMBER), ("groups", _GROUPS)):
        out += [(shape, m.start(), m.end()) for m in pattern.finditer(text)]
    if ":" in text:
        out += [("colons", m.start(), m.end()) for m in _COLONS.finditer(text)]
    return out


# Words that often stand before personal data, by kind.
HINTS = (
    ("mail", "email", "e-mail", "contact", "write", "kontakt", "correo", "courriel"),
    ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "teléfono"),
    ("card", "visa", "credit", "account", "karte", "carte", "tarjeta", "iban"),
    ("ip", "host", "server", "address", "client", "adresse"),
)


def _is_ipv6(span: str) -> bool:
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return True


def features(text: str, shape: str, start: int, end: int) -> list[float]:
    span, n = text[start:end], end - start
    digits = _digits(span)
    groups = re.split(r"[^0-9A-Za-z]+", span)
    sizes = [len(g) for g in groups if g] or [0]
    numbers = [g for g in groups if g.isdecimal()]
    tail = span.rsplit(".", 1)[-1]
    before, after = text[start - 1:start], text[end:end + 1]
    near = set(re.findall(r"[\w-]+", text[max(0, start - 40):start].lower())[-4:])
    return [
        float(SHAPES.index(shape)), n, len(digits), len(digits) / n, sum(c.isalpha() for c in span) / n,
        span.startswith("+"), "(" in span, len(sizes), max(sizes), min(sizes), sizes[0], sizes[-1],
        span.count("."), span.count(" "), span.count("-"), span.count(":"), span.count("/"), span.count("@"),
        13 <= len(digits) <= 19 and luhn(digits), len(numbers) == 4 and all(map(_small, numbers)),
        tail.isalpha() and 2 <= len(tail) <= 10, digits[:1] == "0", len(set(digits)),
        before.isalnum(), before == " " or not before, before in "=\"'#$_-.:/" and bool(before),
        after.isalnum(), after in "=\"'#$_-:/%" and bool(after), shape == "colons" and _is_ipv6(span),
        *[bool(near & set(words)) for words in HINTS],
    ]


def _rewrites(text: str, kind: str, start: int, end: int, draw) -> list[tuple[str, str, int, bool]]:
    """(shape, new span, label) of rewritten copies and near misses of a base span."""
    span, digits = text[start:end], _digits(text[start:end])
    out: list[tuple[str, str, bool]] = []
    if kind == "phone" and len(digits) >= 10:
        local = digits[-10:]
        out += [("number", f"({local[:3]}) {local[3:6]}-{local[6:]}", True),
                ("number", f"{local[:3]}-{local[3:6]}-{local[6:]}", True),
                ("number", f"20{local[:2]}-{int(local[2]) % 9 + 1:02d}-{int(local[4]) % 27 + 1:02d}", False),
                ("number", f"{local[:2]}/{local[2:4]}/19{local[4:6]}", False), ("number", local[:9], False)]
    elif kind == "email":
        name, _, domain = span.partition("@")
        host, _, tld = domain.rpartition(".")
        host = host.rsplit(".", 1)[-1] or "mail"
        out += [("spelled", f"{name.strip('.')[-20:]} [at] {host} [dot] {tld}", True),
                ("spelled", f"{name.strip('.')[-20:]} (at) {host} (dot) {tld}", True),
                ("mail", f"{name[-40:]}@mail_{host}.{tld}", True), ("mail", f"{name[-40:]}@{host[:1]}ü{host[1:]}.{tld}", True),
                ("mail", f"@{host}", False), ("mail", f"{host}@{len(name)}", False), ("mail", f"{host}@v{len(name)}", False),
                ("mail", f"{len(host)}@{len(name)}", False),
                ("spelled", f"look at {host} dot {tld}s", False)]
        if not host.isdecimal():
            out.append(("mail", f"{name[-40:]}@{host}", True))
    elif kind == "ip":
        a, b, c, d = [p[-3:] for p in span.split(".")]
        out += [("groups", f"{a}.{b}.{c}.{int(d) + 256}", False), ("groups", f"{a[:1]}.{b[:1]}.{c[:1]}.{d[:1]}.{a[:1]}", False),
                ("groups", f"{a},{b}23,{c}45,{d}67", False), ("colons", f"{a}:{b}:{c}:{d}", False)]
        out += [("groups", f"{a} . {b} . {c} . {d}", True), ("groups", f"{a}[.]{b}[.]{c}[.]{d}", True),
                ("groups", f"{a} . {b} . {c} . {int(d) + 256}", False), ("groups", f"{a}, {b}, {c}, {d}", False),
                ("groups", f"{a[:1]}. {b[:1]}. {c[:1]}. {d[:1]}", False)]
        words = [f"{w:x}" for w in draw.integers(1, 1 << 16, 8).tolist()]
        h, m, sec, frame = (int(draw.integers(n)) for n in (24, 60, 60, 25))
        out += [("colons", ":".join(words), True), ("colons", f"2001:{words[1]}::{words[6]}:{words[7]}", True),
                ("colons", f"fe80::{words[7]}", True),
                ("colons", ":".join(f"{w:02x}" for w in draw.integers(256, size=6).tolist()), True),
                ("colons", f"{h:02d}:{m:02d}:{sec:02d}", False), ("colons", f"{h}:{m:02d}:{sec:02d}", False),
                ("colons", f"{h:02d}:{m:02d}:{sec:02d}:{frame:02d}", False),
                ("colons", f"2024:{h % 12 + 1:02d}:{frame + 1:02d}:{h:02d}:{m:02d}", False),
                ("colons", f"{'abcdef'[m % 6]}::{'abcdef'[sec % 6]}", False)]
    elif kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(draw.integers(9))) % 10)
        out += [("number", digits[:4] + "/" + digits[4:8] + "/" + digits[8:12] + "/" + digits[12:], True),
                ("number", digits[:4] + "." + digits[4:8] + "." + digits[8:12] + "." + digits[12:], True)]
        if not luhn(wrong):
            out += [("number", wrong, False), ("number", wrong[:4] + "." + wrong[4:8] + "." + wrong[8:12] + "." + wrong[12:], False)]
    return out


def examples(text: str) -> list[tuple[list[float], bool]]:
    base = base_spans(text)
    out = []
    seed = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    draw = np.random.Generator(np.random.PCG64(seed))
    for shape, s, e in candidates(text):
        touching = [min(e, e2) - max(s, s2) for _, s2, e2 in base if s < e2 and s2 < e]
        share = max(touching, default=0) / (e - s)
        if share >= 0.8 or not touching:  # what holds a base span and more is neither
            out.append((features(text, shape, s, e), share >= 0.8))
    for kind, s, e in base:
        for shape, new, good in _rewrites(text, kind, s, e, draw):
            changed = text[max(0, s - 60):s] + new + text[e:e + 20]
            at = min(s, 60)
            out.append((features(changed, shape, at, at + len(new)), good))
    return out


@dataclass
class Boosted:
    """Trees as arrays: per tree the inner nodes' feature and cut, and the leaves' values."""
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            total += value[_node(x, feature, cut, DEPTH) - INNER]
        return 1 / (1 + np.exp(-total))


def _node(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node


def node_sums(bins: np.ndarray, n: np.ndarray, good: np.ndarray, model: Boosted, feature: np.ndarray,
              cut: np.ndarray, level: int) -> np.ndarray:
    """(slope, curvature, rows) x nodes of the level x features x bins, of lines that stand for ``n`` equal
    rows, ``good`` of them positive. Trees are told by bins here."""
    p = model.score(bins)
    node = _node(bins, feature, cut, level) - (2 ** level - 1)
    width, most = bins.shape[1], 2 ** level * bins.shape[1] * BINS
    at = ((node[:, None] * width + np.arange(width)) * BINS + bins).ravel()
    parts = [np.bincount(at, np.repeat(v, width), most) for v in (good - n * p, n * p * (1 - p), n)]
    return np.stack(parts).reshape(3, 2 ** level, width, BINS)


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """The trees of rows that are at hand."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    start = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    return boost_counted(lambda *state: node_sums(bins, np.ones(len(x)), y.astype(float), *state), cuts, start)[1]


def boost_counted(sums: Callable, cuts: list[np.ndarray], start: float) -> tuple[Boosted, Boosted]:
    """Gradient boosting of the logistic loss over binned values; splits are searched by bins; ``sums`` adds ``node_sums`` up over all
    rows. The model by bins, and the same by values."""
    binned, model = Boosted(start=start), Boosted(start=start)
    for _ in range(TREES):
        feature, place, cut = np.zeros(INNER, np.int64), np.full(INNER, BINS), np.full(INNER, np.inf)
        for level in range(DEPTH):
            first = 2 ** level - 1
            g, h, n = sums(binned, feature, place, level)
            leaf = np.zeros((2, 2 ** level, 2))
            for i in range(2 ** level):
                best, split = 1e-3, None
                gs, hs = g[i].cumsum(axis=1), h[i].cumsum(axis=1)
                for f, c in enumerate(cuts):
                    if not len(c) or n[i, f].sum() < 10:
                        continue
                    gl, hl, ga, ha = gs[f, :len(c)], hs[f, :len(c)], gs[f, -1], hs[f, -1]
                    gain = gl ** 2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga ** 2 / (ha + 1)
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, split = gain[at], (f, at)
                whole = np.array([gs[0, -1], hs[0, -1]])
                low = whole
                if split:
                    f, at = split
                    feature[first + i], place[first + i], cut[first + i] = f, at, cuts[f][at]
                    low = np.array([gs[f, at], hs[f, at]])
                leaf[:, i] = np.stack([low, whole - low], axis=1)
        value = RATE * leaf[0].ravel() / (leaf[1].ravel() + 1)
        for m, where in ((binned, place), (model, cut)):
            m.feature.append(feature)
            m.cut.append(where)
            m.value.append(value)
    return binned, model


def thresholds(lines: pd.DataFrame) -> dict[str, float]:
    """Per shape the lowest score from which on the precision holds; none if none is known to. Lines
    (shape, step, n, good): counts by score in steps of 1 / STEPS."""
    out = {}
    for i, shape in enumerate(SHAPES):
        rows = lines[lines["shape"] == i].sort_values("step", ascending=False)
        seen, good = rows["n"].to_numpy().cumsum(), rows["good"].to_numpy().cumsum()
        fine = np.nonzero((good >= PRECISION * seen) & (seen >= 20))[0]
        out[shape] = float(rows["step"].iloc[fine[-1]]) / STEPS if len(fine) else np.inf
    return out


def _matrix(bins: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), -1)


def _summed(lines: DataFrame, n_lines: int) -> Callable:
    """``sums`` for ``boost_counted``: by tasks, or at once where the distinct lines are few."""
    if n_lines <= LINES_PER_TASK:
        few = lines.toPandas()
        held = _matrix(few["bins"]), few["n"].to_numpy(float), few["good"].to_numpy(float)
        return lambda *state: node_sums(*held, *state)
    kept = lines.coalesce(-(-n_lines // LINES_PER_TASK)).cache()

    def sums(*state) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum(node_sums(_matrix(b["bins"]), b["n"].to_numpy(float), b["good"].to_numpy(float), *state)
                        for b in batches if len(b))
            yield pd.DataFrame({"total": [np.ravel(total)] if isinstance(total, np.ndarray) else []})

        parts = kept.mapInPandas(part, "total array<double>")
        few = int(kept.rdd.getNumPartitions() ** 0.5)
        if few > 2:
            parts = parts.repartition(few).mapInPandas(_added, "total array<double>")
        return sum(np.array(r["total"]) for r in parts.collect()).reshape(3, 2 ** state[-1], -1, BINS)

    return sums


def train(docs: DataFrame, text_col: str) -> Boosted | None:
    """From all documents, equal texts once. Examples are counted by their binned values, which is all that
    the trees look at; the documents kept aside are counted by score."""
    def learn_from(text: str | None) -> dict:
        code = hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest()
        return {"code": code, "rows": [{"x": list(map(float, x)), "y": bool(y)} for x, y in examples(text or "")]}

    kind = "struct<code:string,rows:array<struct<x:array<double>,y:boolean>>>"
    found = materialized(map_texts(docs, text_col, text_col, lambda: learn_from, "e", kind).select("e.code", "e.rows")
                         .filter(F.size("rows") > 0).dropDuplicates(["code"])
                         .select((F.conv(F.substring("code", 1, 12), 16, 10).cast("bigint") % FOLDS == 0).alias("aside"),
                                 F.inline("rows")))
    width = len(features("", SHAPES[0], 0, 1))
    shares = F.array(*[F.lit(float(v)) for v in np.linspace(0, 1, BINS)[1:-1]])
    told = found.filter("not aside").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("good"), *[
        F.percentile(F.get("x", F.lit(f)), shares).alias(f"q{f}") for f in range(width)]).first()
    if not 20 <= told["good"] <= told["n"] - 20:
        return None
    cuts = [np.unique(told[f"q{f}"]) for f in range(width)]

    def bin_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist())
                bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
                yield pd.DataFrame({"aside": b["aside"], "shape": x[:, 0].astype(int), "good": b["y"].astype(int),
                                    "bins": [r.tobytes() for r in bins.astype(np.uint8)]})

    lines = materialized(found.mapInPandas(bin_up, "aside boolean, shape int, good int, bins binary")
                         .groupBy("aside", "shape", "bins").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")))
    learnt = lines.filter("not aside")
    rate = told["good"] / told["n"]
    binned, model = boost_counted(_summed(learnt, learnt.count()), cuts, float(np.log(rate / (1 - rate))))

    def by_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[["shape", "n", "good"]].assign(step=np.floor(binned.score(_matrix(b["bins"])) * STEPS).astype(int))

    # at most STEPS + 1 lines per shape
    model.thresholds = thresholds(lines.filter("aside").mapInPandas(by_score, "shape int, n bigint, good bigint, step int")
                                  .groupBy("shape", "step").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas())
    return model


def added_spans(text: str, base: list[Span], model: Boosted) -> list[Span]:
    """Chosen candidates that touch neither a base span nor a better one."""
    near = [c for c in candidates(text) if not any(c[1] < e and s < c[2] for _, s, e in base)]
    if not near:
        return []
    score = model.score(np.array([features(text, *c) for c in near], float))
    out: list[Span] = []
    for s, (shape, start, end) in sorted(zip(score, near, strict=True), key=lambda c: (-c[0], c[1][1], c[1][2])):
        if s >= model.thresholds[shape] and not any(start < e and b < end for _, b, e in out):
            out.append((shape, start, end))
    return sorted(out, key=lambda c: (SHAPES.index(c[0]), c[1]))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, spans (array of kind, start, end, base)."""
    model = train(df, text_col)

    def spans(text: str | None) -> list[dict]:
        base = base_spans(text or "")
        more = added_spans(text or "", base, model) if model else []
        return [{"kind": k, "start": s, "end": e, "base": b}
                for part, b in ((base, True), (more, False)) for k, s, e in part]

    return map_texts(df, id_col, text_col, lambda: spans, "spans", SPANS).withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in brackets."""
    model = train(df, text_col)

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _hidden(t, model))

    return df.withColumn(text_col, hidden(F.col(text_col).cast("string")))


def _hidden(text: str, model: Boosted | None) -> str:
    base = base_spans(text)
    spans = sorted([*base, *(added_spans(text, base, model) if model else [])], key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        elif end <= at:
            continue
        at = max(at, end)
    return "".join([*out, text[at:]])
