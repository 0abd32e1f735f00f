"""Secret scanning: exact patterns, and a character CNN over every other candidate and its context.

Patterns find the base spans. Candidates are all other long runs of key-like characters that no base span touches; a
convolutional network (numpy) reads each with the characters around it, in overlapping windows where it is longer than
one, and adds those that it scores over the threshold of their shape (hex digits, letters and digits, base64, dashed).
The network is trained on labelled findings: a given table of them if there is one, drawn secrets and look-alikes of
known formats, and of a bounded sample of documents the spans that the patterns label, and as no secrets the candidates
all of whose letters are words that the sample's documents share. Other candidates of the sample have no label that could
be trusted, and none is used. A quarter of the findings is held out: scores are calibrated on it, and a shape's threshold
is the largest that keeps the wanted recall there, whatever precision that leaves.

Every text is read whole in one pass without a shuffle. Defined results: a null or empty text has no spans; equal rows
get equal spans; an empty table gives an empty result, and training then has the drawn findings alone. Ids are of any
type. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, small_batches

# Fixed patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9+/_=-]")
#: Runs of letters in a candidate, parted where the case rises; a candidate of known words has no longer run of digits.
LETTERS, DIGITS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"[0-9]+")
MOST_DIGITS = 6
SHAPES = ("hex", "alnum", "base64", "dashed")

#: Characters of a window: before the candidate, of the candidate, after it; step between windows of a long one.
BEFORE, INSIDE, AFTER, STEP = 24, 40, 8, 20
WIDTH = BEFORE + INSIDE + AFTER
#: Documents and findings that training takes from the corpus, at most.
TRAIN_DOCS, TRAIN_FINDINGS = 2000, 2000
#: Documents of the sample that a word is shared by; held-out secrets from which on a shape has its own threshold.
SHARED, LEAST_OF_SHAPE = 3, 40
RECALL = 0.98

Span = tuple[str, int, int]


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: Sequence[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str | None, base: Sequence[Span]) -> list[tuple[int, int]]:
    """Key-like runs that no base span touches."""
    if not text:
        return []
    found = (m.span() for m in CANDIDATE.finditer(text))
    return [(a, b) for a, b in found if not any(s < b and a < e for _, s, e in base)] if base else list(found)


def shape(run: str) -> str:
    """Of a candidate: hex, alnum, base64 or dashed."""
    if all(c in "0123456789abcdefABCDEF" for c in run):
        return "hex"
    return "alnum" if run.isalnum() else "base64" if any(c in "+/=" for c in run) else "dashed"


def made_of(run: str, words: set[str]) -> bool:
    """All longer runs of letters are words, and numbers are short."""
    return all(len(x) < 3 or x.lower() in words for x in LETTERS.findall(run)) and all(len(x) <= MOST_DIGITS for x in DIGITS.findall(run))


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate with its context, in windows that together show all of it."""
    out, at = [], start
    while True:
        stop = min(end, at + INSIDE)
        before = text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0")
        inside = text[at:stop].ljust(INSIDE, "\0")
        out.append(before + inside + text[stop : stop + AFTER].ljust(AFTER, "\0"))
        if stop == end:
            return out
        at += STEP


class Finding(NamedTuple):
    windows: list[str]
    label: int
    shape: str


def finding(text: str, start: int, end: int, label: int) -> Finding:
    return Finding(windows(text, start, end), label, shape(text[start:end]))


def encode(texts: Sequence[str]) -> np.ndarray:
    """(n, WIDTH) codes: ASCII as it is, one code for all else."""
    if not texts:
        return np.zeros((0, WIDTH), np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), WIDTH)
    return np.minimum(codes, 127).astype(np.int64)


@dataclass
class CharCNN:
    """Embedding, one convolution with ReLU, maxima over the candidate and over its context, a linear layer."""

    embed: np.ndarray  # (128, E)
    kernel: np.ndarray  # (K * E, C)
    shift: np.ndarray  # (C,)
    out: np.ndarray  # (2 * C,)
    bias: np.ndarray  # (1,)
    scale: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SHAPES, 0.5))

    K = 5

    @classmethod
    def new(cls, rng: np.random.Generator, size: int = 12, channels: int = 24) -> CharCNN:
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        return cls(rng.normal(0, 0.3, (128, size)), draw(cls.K * size, channels), np.zeros(channels), draw(2 * channels), np.zeros(1))

    def columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        n = x.shape[1] - self.K + 1
        return np.concatenate([e[:, i : i + n] for i in range(self.K)], axis=2)

    def parts(self, n: int) -> list[np.ndarray]:
        inside = np.zeros(n, bool)
        inside[BEFORE : BEFORE + INSIDE - self.K + 1] = True
        return [np.flatnonzero(inside), np.flatnonzero(~inside)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        cols = self.columns(x)
        act = np.maximum(cols @ self.kernel + self.shift, 0)
        where = [p[act[:, p].argmax(axis=1)] for p in self.parts(act.shape[1])]
        pooled = np.concatenate([np.take_along_axis(act, w[:, None], 1)[:, 0] for w in where], axis=1)
        return pooled @ self.out + self.bias, (x, cols, where, pooled)

    def gradients(self, kept: tuple, d: np.ndarray) -> list[np.ndarray]:
        x, cols, where, pooled = kept
        n, channels = len(x), len(self.shift)
        dp = d[:, None] * self.out * (pooled > 0)
        g_kernel, g_shift, g_embed = np.zeros_like(self.kernel), np.zeros_like(self.shift), np.zeros_like(self.embed)
        size, rows = self.embed.shape[1], np.arange(n)
        for j, w in enumerate(where):
            own = dp[:, j * channels : (j + 1) * channels]
            g_shift += own.sum(0)
            for c in range(channels):
                g_kernel[:, c] += cols[rows, w[:, c]].T @ own[:, c]
                back = (own[:, c, None] * self.kernel[:, c]).reshape(n, self.K, size)
                for i in range(self.K):
                    np.add.at(g_embed, x[rows, w[:, c] + i], back[:, i])
        return [g_embed, g_kernel, g_shift, pooled.T @ d, d.sum(keepdims=True)]

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 8, batch: int = 64, rate: float = 0.005) -> CharCNN:
        names = ("embed", "kernel", "shift", "out", "bias")
        m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                z, kept = self.forward(x[at])
                t += 1
                for k, g in zip(names, self.gradients(kept, (sigmoid(z) - y[at]) / len(at)), strict=True):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
        return self

    def calibrate(self, found: Sequence[Finding], recall: float = RECALL) -> CharCNN:
        """Platt scaling on held-out findings, then each shape's largest threshold with the wanted recall there; a shape
        with few secrets held out takes that of all."""
        z, y = self.highest([f.windows for f in found]), np.array([f.label for f in found], np.float64)
        a, b = 1.0, 0.0
        for _ in range(300):
            d = sigmoid(a * z + b) - y
            a, b = a - 0.05 * float((d * z).mean()), b - 0.05 * float(d.mean())
        self.scale, self.offset = max(a, 1e-3), b
        p, of = sigmoid(self.scale * z + b), np.array([f.shape for f in found])
        largest = lambda q: float(np.sort(q)[int((1 - recall) * len(q))]) if len(q) else 0.5
        secret = y == 1
        for name in SHAPES:
            own = secret & (of == name)
            self.thresholds[name] = largest(p[own if own.sum() >= LEAST_OF_SHAPE else secret])
        return self

    def highest(self, cut: Sequence[Sequence[str]]) -> np.ndarray:
        """The highest raw score of each candidate's windows."""
        x = encode([w for ws in cut for w in ws])
        z = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)])
        return np.maximum.reduceat(z, np.cumsum([0, *map(len, cut)])[:-1])

    def score(self, cut: Sequence[Sequence[str]]) -> np.ndarray:
        """Calibrated probabilities of candidates, each given as its windows."""
        return sigmoid(self.scale * self.highest(cut) + self.offset) if len(cut) else np.empty(0)

    def finds(self, text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
        """The candidates that reach the threshold of their shape; of a text with many, some at a time."""
        out = []
        for i in range(0, len(spans), 256):
            some = spans[i : i + 256]
            p = self.score([windows(text, s, e) for s, e in some])
            out += [(s, e) for (s, e), q in zip(some, p, strict=True) if q >= self.thresholds[shape(text[s:e])]]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def drawn(n: int, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """Labelled findings of known formats: text, start, end, 1 for a secret."""
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: some("aeiourstnldh", rng.randint(2, 9))
    raw = lambda k: bytes(rng.getrandbits(8) for _ in range(k))
    secrets = [
        lambda: some(upper + lower + digits, rng.randint(24, 64)),
        lambda: base64.b64encode(raw(rng.randint(18, 48))).decode(),
        lambda: base64.urlsafe_b64encode(raw(rng.randint(18, 48))).decode(),
        lambda: raw(rng.randint(12, 32)).hex().upper(),
        lambda: rng.choice(["sk_live_", "pk_live_", "ghp_", "xoxb-", "glpat-", "AIza", "SG."]) + some(upper + lower + digits, rng.randint(20, 40)),
        lambda: some(upper + lower, rng.randint(20, 40)),
        lambda: some(lower + digits, rng.randint(20, 40)),
        lambda: "-".join(some(upper + digits, rng.randint(4, 6)) for _ in range(rng.randint(3, 6))),
        lambda: "eyJ" + base64.urlsafe_b64encode(raw(20)).decode().rstrip("=") + "." + base64.urlsafe_b64encode(raw(30)).decode().rstrip("="),
    ]
    likes = [
        lambda: f"{word()}.{rng.randint(1, 99)}-{word()}.example.com",
        lambda: f"{word()}/{word()}/{word()}-{rng.randint(1, 999)}.html",
        lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}-{word()}-{word()}",
        lambda: f"{word()}_{word()}_{word()}{rng.randint(0, 99)}",
        lambda: f"{word()}{word().title()}{word().title()}{rng.randint(0, 99)}",
        lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-{word()}-{word()}",
        lambda: "-".join(str(rng.randint(0, 999)) for _ in range(6)),
        lambda: some(digits, rng.randint(16, 30)),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))),
        lambda: rng.choice("-_.").join(word() for _ in range(rng.randint(3, 6))),
        lambda: "".join(word().title() for _ in range(rng.randint(3, 5))),
        lambda: "".join(word() for _ in range(4))[:30],
        lambda: f"{word()}.{word()}.example.{rng.choice(['com', 'org'])}/{word()}/{word()}",
        lambda: rng.choice("=-_0") * rng.randint(16, 40) + "1",
        lambda: f"{word()}-{word()}-{word()}-{rng.randint(1, 2000)}",
    ]
    out = []
    for i in range(n):
        body = rng.choice(secrets if i % 2 else likes)()
        lead = " ".join(word() for _ in range(rng.randint(0, 6)))
        if i % 2 and rng.random() < 0.5:
            lead += f" {rng.choice(['key', 'auth', 'credential', 'bearer', 'access', 'private', 'pwd'])}{rng.choice([': ', ' = ', '=', ' '])}"
        else:
            lead += rng.choice([" ", " (", ' "', ": ", "/"])
        out.append((f"{lead}{body} {word()} {word()}", len(lead), len(lead) + len(body), i % 2))
    return out


def sample_findings(docs: DataFrame, key: str, text: str, most_docs: int = TRAIN_DOCS, most: int = TRAIN_FINDINGS) -> list[Finding]:
    """At most ``most`` findings in about ``most_docs`` documents that a hash of key and text picks: the patterns' spans are
    secrets, candidates of words that the sample shares are not."""
    total = docs.count()  # of parquet, from the footers alone
    share = min(1.0, most_docs / max(1, total))
    picked = docs.where(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit(29)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = cut(picked.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).distinct())
    each = sample.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit("[a-z]{3,40}"), F.lit(0)))).alias("w"))
    words = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED)
    held = docs.sparkSession.sparkContext.broadcast({r["w"] for r in words.collect()})  # words of a bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                spans = base_spans(t)
                out += [finding(t, s, e, 1) for kind, s, e in spans if kind != "assign"]
                out += [finding(t, max(s, e - INSIDE), e, 1) for kind, s, e in spans if kind == "assign"]
                out += [finding(t, s, e, 0) for s, e in candidates(t, spans) if made_of(t[s:e], held.value)]
            yield pd.DataFrame(out, columns=list(Finding._fields))

    found = sample.mapInPandas(run, "windows array<string>, label int, shape string").distinct()
    return [Finding(*r) for r in found.orderBy(F.xxhash64("windows", "label"), F.col("windows")[0]).limit(most).collect()]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL, seed: int = 5, findings: DataFrame | None = None) -> CharCNN:
    """Fit on drawn, sampled and given findings, a quarter held out to calibrate. The same input gives the same network.
    ``findings``: text, start, end (code points), label (1: a secret), the first ``TRAIN_FINDINGS`` by hash."""
    small_batches(docs.sparkSession)
    found = [finding(*x) for x in drawn(3600, seed)] + sample_findings(docs, key, text)
    if findings is not None:
        some = findings.select("text", "start", "end", "label").dropna().distinct().orderBy(F.xxhash64("text", "start", "end"), "label").limit(TRAIN_FINDINGS)
        found += [finding(*r) for r in some.collect()]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(found))
    held, rest = ([found[i] for i in part] for part in (order[: len(found) // 4], order[len(found) // 4 :]))
    x = encode([w for f in rest for w in f.windows])
    y = np.array([f.label for f in rest for _ in f.windows], np.float64)
    return CharCNN.new(rng).fit(x, y, rng).calibrate(held, recall)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: CharCNN | None = None) -> DataFrame:
    """``key`` and findings, an array of (kind, start, end, match) in order, of every row. Kind ``model`` is the network's."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, key, text))

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                spans = in_order([*base, *(("model", s, e) for s, e in held.value.finds(t, candidates(t, base)))])
                out.append([{"kind": k, "start": s, "end": e, "match": t[s:e]} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=[key, "findings"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, rows.select(key, F.lit(None).cast("array<struct<kind: string, start: int, end: int, match: string>>").alias("findings")).schema)


def digest(spans: Sequence[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
