"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans. The field labels tokens with a digit or an @; all other tokens are fixed to "none",
which cuts a document's chain into short runs without changing the inference. Adjacent tokens are linked, and so are
successive occurrences of the same or a similar token (same digits, or same letters and digits) however far apart.
Loopy sum-product passing over these links lets a token take the label that its repeats have. It is trained by
pseudo-likelihood on the base spans of a bounded sample. A token that no base span touches and whose marginal for a kind
is at least ``SURE`` becomes a span of that kind.

All patterns are matched in linear time: runs are found whole instead of retried from each start.

Edge cases: null and empty texts have no spans; repeated rows are treated alike; an empty table or one without digits
or @ trains no field and keeps the base spans alone; other columns pass through unchanged, of whatever type and name.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_text

KINDS = ("email", "ip", "card", "phone")
#: Rows of the sample that the field is fitted on, and tokens of them, at most about.
FIT_DOCS, FIT_TOKENS = 4000, 40_000
SURE = 0.97
ROUNDS = 8
#: Tokens of the texts whose field is solved at once, about, and links of it that are worked on at once.
TOKENS, LINKS = 20_000, 1 << 16

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_BLANK = frozenset(" \t\n\r\x0b\x0c")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans in code points, by kind and then start."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append((0, start, end))
    for m in _DOTTED.finditer(text):
        parts = [(d.start(), d.end()) for d in _DIGITS.finditer(text, m.start(), m.end())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                out.append((1, four[0][0], four[3][1]))
    for kind, pattern in ((2, _CARD), (3, _PHONE)):
        if kind == 3 and "+" not in text:
            continue
        for m in pattern.finditer(text):
            digits = "".join(_DIGITS.findall(m[0]))
            if (13 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


@dataclass
class Graph:
    """Candidate tokens of a text."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    chain: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs of like tokens


_SIZES = (1, 3, 6, 8, 12, 19)
N_FEATURES = 7 + 1 + 14


def _features(token: str, before: bool, after: bool) -> list[int]:
    digits = "".join(_DIGITS.findall(token))
    n = len(digits)
    size = [0] * 7
    size[sum(n > k for k in _SIZES)] = 1
    letters = any(c.isalpha() for c in token)
    plain = token.strip(".,;:!?\"'()[]<>*#$%&")
    return [
        *size,
        1,
        "@" in token,
        "@" in token and "." in token.rpartition("@")[2],
        plain.count(".") == 3,
        plain.count(".") == 3 and not letters,
        token.startswith("+"),
        "(" in token,
        "-" in token,
        plain.isdigit(),
        letters,
        13 <= n <= 19 and not letters and luhn(digits),
        token[0] in "\"'",
        "=" in token,
        not before,
        not after,
    ]


def graph(text: str) -> Graph:
    spans: list[tuple[int, int]] = []
    n, end = len(text), 0
    for m in _HIT.finditer(text):
        p = m.start()
        if p < end:
            continue
        start, low = p, end
        while start > low and text[start - 1] not in _BLANK:
            start -= 1
        end = p + 1
        while end < n and text[end] not in _BLANK:
            end += 1
        spans.append((start, end))
    joined = [False] * (len(spans) + 1)
    for i in range(1, len(spans)):
        gap = text[spans[i - 1][1] : spans[i][0]] if spans[i][0] - spans[i - 1][1] < 16 else "x"
        joined[i] = not gap.strip(" \t\n\r\x0b\x0c")
    rows, chain, skip, last = [], [], [], {}
    for i, (a, b) in enumerate(spans):
        token = text[a:b]
        rows.append(_features(token, joined[i], joined[i + 1]))
        if joined[i]:
            chain.append((i - 1, i))
        digits = "".join(_DIGITS.findall(token))
        like = digits if len(digits) > 6 else "".join(c for c in token.lower() if c.isalnum())
        if like in last:
            skip.append((last[like], i))
        last[like] = i
    pairs = lambda x: np.array(x, dtype=np.int64).reshape(-1, 2)
    return Graph(spans, np.array(rows, dtype=np.float32).reshape(-1, N_FEATURES), pairs(chain), pairs(skip))


def labels(g: Graph, spans: list[Span]) -> np.ndarray:
    """0 for none, else 1 + kind of the first base span that touches the token."""
    out = np.zeros(len(g.spans), dtype=np.int64)
    order = sorted(spans, key=lambda s: s[1])
    starts = [s[1] for s in order]
    longest = np.maximum.accumulate([s[2] for s in order]) if order else []
    for i, (a, b) in enumerate(g.spans):
        k = int(np.searchsorted(starts, b)) - 1
        while k >= 0 and longest[k] > a:
            if order[k][2] > a:
                out[i] = 1 + order[k][0]
            k -= 1
    return out


def _stack(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = np.cumsum([0, *[len(g.spans) for g in graphs]])
    return (
        np.concatenate([g.features for g in graphs]),
        np.concatenate([g.chain + b for g, b in zip(graphs, base, strict=False)]),
        np.concatenate([g.skip + b for g, b in zip(graphs, base, strict=False)]),
    )


@dataclass(frozen=True)
class Field:
    own: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    def marginals(self, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product passing over the links, all at once in each round."""
        unary = features @ self.own
        n, k = unary.shape
        c, s = len(chain), len(skip)
        src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        back = np.concatenate([np.arange(c, 2 * c), np.arange(c), 2 * c + np.arange(s, 2 * s), 2 * c + np.arange(s)])
        ends = np.cumsum([0, c, c, s, s])
        parts = [(a, min(a + LINKS, z), w) for lo, z, w in zip(ends, ends[1:], (self.chain, self.chain.T, self.skip, self.skip.T), strict=False) for a in range(lo, z, LINKS)]
        message = np.zeros((len(src), k))
        belief = unary
        for _ in range(rounds if len(src) else 0):
            new = np.empty_like(message)
            for a, z, pair in parts:
                out = (belief[src[a:z]] - message[back[a:z]])[:, :, None] + pair
                top = out.max(axis=1)
                new[a:z] = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
            belief = unary + np.column_stack([np.bincount(dst, message[:, j], minlength=n) for j in range(k)])
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(graphs: list[Graph], gold: list[np.ndarray], steps: int = 300, rate: float = 0.1) -> Field | None:
    """Maximum pseudo-likelihood with a small quadratic penalty (Adam)."""
    if not graphs:
        return None
    features, chain, skip = _stack(graphs)
    y = np.concatenate(gold)
    k, n = len(KINDS) + 1, len(y)
    hot = np.eye(k)[y]
    sides = []
    for pairs in (chain, skip):
        sides.append((pairs[:, 0], pairs[:, 1]))
    near = np.zeros((4, n, k))  # labels of neighbours: before, after, like before, like after
    for j, (a, b) in enumerate(sides):
        np.add.at(near[2 * j], b, hot[a])
        np.add.at(near[2 * j + 1], a, hot[b])
    theta = [np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        own, pair, like = theta
        score = features @ own + near[0] @ pair + near[1] @ pair.T + near[2] @ like + near[3] @ like.T
        p = np.exp(score - score.max(axis=1, keepdims=True))
        d = (hot - p / p.sum(axis=1, keepdims=True)) / n
        grads = [
            features.T @ d - 1e-4 * own,
            near[0].T @ d + d.T @ near[1] - 1e-4 * pair,
            near[2].T @ d + d.T @ near[3] - 1e-4 * like,
        ]
        for t, g, u, v in zip(theta, grads, first, second, strict=True):
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            t += rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(*theta)


def added_spans(g: Graph, base: list[Span], p: np.ndarray) -> list[Span]:
    """Tokens that no base span touches and whose marginal is sure, neighbours of one kind as one span."""
    best = p.argmax(axis=1)
    best[p.max(axis=1) < SURE] = 0
    best[labels(g, base) > 0] = 0
    joined = {(int(a), int(b)) for a, b in g.chain}
    out: list[Span] = []
    for i in np.flatnonzero(best):
        a, b = g.spans[i]
        kind = int(best[i]) - 1
        if (i - 1, i) in joined and out and out[-1][0] == kind and out[-1][2] == g.spans[i - 1][1]:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return sorted(out)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Field | None:
    """The field of a bounded sample of ``docs``, drawn by the hash of ``key`` and text from the rows with a digit or @."""
    own = docs.select(F.xxhash64(key, F.lit("pii"), text).alias("h"), F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
    rows = docs.count()
    drawn = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    sample = own.where(drawn <= min(1.0, FIT_DOCS / max(rows, 1)))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, t in zip(pdf["h"], pdf["t"], strict=True):
                g = graph(t)
                out.append((h, len(g.spans), pickle.dumps((g, labels(g, base_spans(t))))))
            yield pd.DataFrame(out, columns=["h", "n", "x"])

    graphs, gold, held = [], [], 0
    for r in sample.mapInPandas(tokens, "h long, n long, x binary").orderBy("h", "n", "x").toLocalIterator():
        g, y = pickle.loads(r.x)
        graphs.append(g)
        gold.append(y)
        held += r.n
        if held >= FIT_TOKENS:
            break
    return train(graphs, gold)


def find(texts: list[str | None], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    base = [base_spans(t) if t and _HIT.search(t) else [] for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, Graph]] = []

    def solve() -> None:
        p, at = field.marginals(*_stack([g for _, g in held])), 0
        for i, g in held:
            added[i] = added_spans(g, base[i], p[at : at + len(g.spans)])
            at += len(g.spans)
        held.clear()

    tokens = 0
    for i, t in enumerate(texts if field is not None else ()):
        if t and _HIT.search(t):
            held.append((i, graph(t)))
            tokens += len(held[-1][1].spans)
            if tokens >= TOKENS:
                solve()
                tokens = 0
    if held:
        solve()
    return list(zip(base, added, strict=True))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or union of spans that overlap, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans in ``text`` masked, and ``n_chars`` counted anew where there is such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def work(texts: list[str | None]) -> dict[str, list[str | None]]:
        found = find(texts, shared.value)
        return {"text": [masked(t, b + a) if b or a else t for t, (b, a) in zip(texts, found, strict=True)]}

    out = map_text(docs, "text", work, {"text": "string"}).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


OUT = {"n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_sha256": "string", "spans": "string", "n_spans": "long"}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the numbers of base spans, their digest, all spans and their number (``OUT``) in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text))

    def work(texts: list[str | None]) -> dict[str, list]:
        found = find(texts, shared.value)
        out: dict[str, list] = {f"n_{kind}": [sum(s[0] == k for s in base) for base, _ in found] for k, kind in enumerate(KINDS)}
        out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
        out["spans"] = [written(base + added) for base, added in found]
        out["n_spans"] = [len(base) + len(added) for base, added in found]
        return out

    return map_text(docs, text, work, OUT, drop=[text])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
