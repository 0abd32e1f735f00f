"""Quality rules as a short-circuit cascade.

Each rule looks at one document and rejects it or not. A bounded sample gives every rule its cost (seconds a document)
and selectivity (share rejected); the cascade then runs the rules by rejections per second, highest first, and stops
at the first that rejects. The order changes the work and the name of the first failing rule, never the verdict.

Defined results: a null or empty text has no words and is rejected by ``few_words``; whole texts are read, however
long; equal rows get equal verdicts; an empty table gives an empty result; other columns pass through, and columns
whose names clash with the appended ones are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, place, small_batches

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Documents on which costs and selectivities are estimated, at most.
SAMPLE_ROWS = 4000


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Positions covered by windows of ``width`` (a power of two) ids that occur twice or more. Exact: window ids are
    built by doubling, from pairs of ids of half the width."""
    n = len(ids)
    if n <= width:
        return 0
    w, of = 1, ids.astype(np.int64)
    while w < width:
        of = of[:-w] * (of.max() + 1) + of[w:]
        values, of, counts = np.unique(of, return_inverse=True, return_counts=True)
        if len(values) == len(of):
            return 0
        w *= 2
    starts = np.flatnonzero(counts[of] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


class Doc:
    """A text's features, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII blanks alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words <= WINDOW:
            return 0
        known: dict[bytes, int] = {}
        return repeated_words(np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words))

    @cached_property
    def shouted(self) -> float:
        """Share of upper case among cased letters."""
        low = sum(map(str.islower, self.text))
        up = sum(map(str.isupper, self.text))
        return up / max(1, low + up)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def few_words(d: Doc) -> bool:
    return d.n_words < MIN_WORDS


def repeats(d: Doc) -> bool:
    return 100 * d.n_repeat_words > 30 * d.n_words


def symbols(d: Doc) -> bool:
    return 100 * d.n_symbols > 30 * d.n_words


def dup_lines(d: Doc) -> bool:
    return 100 * d.n_dup_lines > 50 * len(d.lines)


def word_length(d: Doc) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 40 * d.n_words


def shouting(d: Doc) -> bool:
    return d.shouted > 0.5


#: The first two are the base rules of the digest query; all are language-neutral and lenient.
RULES = tuple(Rule(f.__name__, f) for f in (few_words, repeats, symbols, dup_lines, word_length, shouting))


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> DataFrame:
    """One row a rule: rule, n, rejected, seconds, over at most ``sample_rows`` documents from all partitions."""
    total = docs.count()
    part = docs.select("text") if total <= sample_rows else docs.select("text").sample(sample_rows / total, seed).limit(sample_rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in rules:
                began = time.perf_counter()
                hits = sum(r.rejects(Doc(t)) for t in b["text"])
                out.append((r.name, len(b), hits, time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["rule", "n", "rejected", "seconds"])

    small_batches(docs.sparkSession)
    return (
        part.mapInPandas(measure, "rule string, n long, rejected long, seconds double")
        .groupBy("rule")
        .agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    )


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on the sample; rules without rejections last, the cheapest first."""
    seen = {r["rule"]: r for r in estimate(docs, rules, sample_rows).collect()}  # one row a rule

    def rank(r: Rule) -> tuple[float, float]:
        x = seen.get(r.name)
        return (0.0, 0.0) if x is None else (-x["rejected"] / max(x["seconds"], 1e-9), x["seconds"])

    return sorted(rules, key=rank)


def verdict(d: Doc, cascade: Sequence[Rule]) -> str | None:
    """The name of the first rule that rejects."""
    return next((r.name for r in cascade if r.rejects(d)), None)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, all columns as they were. One pass, no shuffle; later rules see only survivors."""
    cascade, at = plan_cascade(docs, rules, sample_rows), place(docs, "text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([verdict(Doc(t), cascade) is None for t in b.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(sift, docs.schema)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows with the measures (long) and ``first_failed`` (string, null if kept) appended."""
    cascade = plan_cascade(docs, rules, sample_rows)
    text = free_name(docs, "_text")
    new = [*MEASURES, "first_failed"]
    rest = [c for c in docs.columns if c not in new]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for c in MEASURES:
        schema = schema.add(c, "long")
    schema = schema.add("first_failed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds = [Doc(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            cols = [b.column(b.schema.get_field_index(c)) for c in rest]
            cols += [pa.array([getattr(d, m) for d in ds], pa.int64()) for m in MEASURES]
            cols.append(pa.array([verdict(d, cascade) for d in ds], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, *new])

    small_batches(docs.sparkSession)
    held = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").alias(text))
    return held.mapInArrow(run, schema)
