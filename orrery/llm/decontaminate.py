"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which positions of a token window count; the others may differ. Windows of benchmark items under each
mask make the test hashes; a document's windows are joined with them where they lie, and every hit is verified: along
its diagonal (document position minus item position) the aligned stretch is grown in both directions, and stays the
best-scoring one under substitutions. Stretches of one item on different diagonals, as insertions leave them, add up.
A document leaks an item if some stretch holds ``MIN_MATCH`` equal tokens (fewer for short items), or if the stretches
near its longest one together cover ``MIN_COVER`` of the item.

The corpus is read once and not shuffled. The benchmark is what is broadcast, in blocks of a checked size: a larger
one makes more passes over the documents, never a larger broadcast.

Tokens are runs of letters and digits in lower case, or single characters of scripts without blanks. The hits of a text
are taken item by item, and diagonals along which a text and an item agree alike are looked at once, so a text that
repeats itself costs no more than its length for each item that it hits. Defined results: a null or empty text, on either side, matches
nothing; an item of fewer than ``MIN_ITEM`` tokens is too short to tell a leak from chance and matches nothing; items
with equal texts are reported each; equal rows get equal rows out; an empty table gives an empty result (or, for
``keep_clean``, an empty benchmark keeps everything). Other columns pass through ``keep_clean`` unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import place, small_batches

#: Scripts written without blanks (Thai, kana, Han) have a token a character.
UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
TOKEN = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
#: 1: the position counts; 0: it may differ.
MASKS = ("111011", "1101101", "1110010011")
MIN_ITEM = 8
MIN_MATCH = 13
MIN_COVER = 0.6
#: Tokens at either end of a stretch are cut off while they match less than this share.
IDENTITY = 0.75
#: Test hashes in one broadcast (8 bytes each, and as much again for places).
BLOCK_HASHES = 2_000_000
#: Stretches of one leak lie on diagonals that insertions move apart by so many tokens, or a quarter of the item.
SHIFT = 5
MISMATCH = -2
DROP = 8
#: Cells (diagonals by tokens of an item) that are compared together.
PIECE = 1 << 20


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows all of whose counted tokens are known (ids over 0)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ok = np.ones(n, bool)
    for o in offsets(mask):
        ok &= ids[o : o + n] > 0
    at = np.flatnonzero(ok)
    h = np.full(len(at), len(mask), np.uint64)
    for o in offsets(mask):
        h = (h ^ ids[at + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, h


@dataclass
class TestBlock:
    """A block of items: their tokens as ids, and their hashes by mask, sorted, each with its item and place."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    items: list[tuple[int | None, np.ndarray]] = field(default_factory=list)
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, key: int | None, words: list[str]) -> None:
        self.items.append((key, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)))

    def close(self) -> TestBlock:
        for mask in MASKS:
            hs, of, at = [], [], []
            for i, (_, ids) in enumerate(self.items):
                places, h = seeds(ids, mask)
                hs.append(h)
                at.append(places)
                of.append(np.full(len(h), i))
            h, of, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (hs, of, at))
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], of[order], at[order]))
        return self

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, its diagonals with a hit, in order), by item."""
        found = []  # by mask: the text's places in order of their hashes, and rows (item, place, range of places)
        for mask, (h, of, at) in zip(MASKS, self.tables, strict=True):
            places, own = seeds(ids, mask)
            lo = np.searchsorted(h, own)
            hit = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == own) if len(h) else np.empty(0, np.int64)
            if not len(hit):
                continue
            order = hit[np.argsort(own[hit], kind="stable")]
            kinds, first, n = np.unique(own[order], return_index=True, return_counts=True)
            start, stop = np.searchsorted(h, kinds, "left"), np.searchsorted(h, kinds, "right")
            each = np.repeat(np.arange(len(kinds)), stop - start)
            row = np.arange(len(each)) + np.repeat(start - (np.cumsum(stop - start) - (stop - start)), stop - start)
            found.append((places[order], np.stack([of[row], at[row], first[each], first[each] + n[each]], axis=1)))
        if not found:
            return
        rows = np.concatenate([np.insert(r, 4, i, axis=1) for i, (_, r) in enumerate(found)])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        for some in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
            yield int(some[0, 0]), np.unique(np.concatenate([found[m][0][a:b] - at for _, at, a, b, m in some]))


def grow(same: np.ndarray, at: int) -> tuple[int, int]:
    """The best-scoring stretch [start, end) around ``at`` of a diagonal's equalities, grown until the score has
    dropped by ``DROP``."""
    ends = []
    for part in (same[at:], same[:at][::-1]):
        score = np.cumsum(np.where(part, 1, MISMATCH))
        if not len(score):
            ends.append(0)
            continue
        dropped = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= DROP)
        score = score[: dropped[0]] if len(dropped) else score
        ends.append(int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0)
    return at - ends[1], at + ends[0]


@dataclass
class Leak:
    item: int
    start: int  # tokens of the document, end exclusive
    end: int
    matched: int  # equal tokens of the longest stretch
    covered: float  # share of the item's tokens that stretches match


def patterns(own: np.ndarray, ids: np.ndarray, diagonals: np.ndarray) -> dict[bytes, list[np.ndarray]]:
    """The diagonals by where the item's tokens equal the text's along them (packed bits), a piece at a time."""
    out: dict[bytes, list[np.ndarray]] = {}
    step, places = max(1, PIECE // len(own)), np.arange(len(own))
    for i in range(0, len(diagonals), step):
        some = diagonals[i : i + step]
        at = some[:, None] + places
        same = (ids[np.clip(at, 0, len(ids) - 1)] == own) & (at >= 0) & (at < len(ids))
        kinds, which = np.unique(np.packbits(same, axis=1), axis=0, return_inverse=True)
        for k, kind in enumerate(kinds):
            out.setdefault(kind.tobytes(), []).append(some[which.ravel() == k])
    return out


def stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """The grown stretches of a diagonal around its hits, those with enough equal tokens."""
    out, end = [], -1
    hit = np.zeros(len(same), bool)
    for mask in MASKS:
        n = len(same) - len(mask) + 1
        if n > 0:
            hit[:n] |= np.logical_and.reduce([same[o : o + n] for o in offsets(mask)])
    for at in np.flatnonzero(hit):
        if at >= end:
            start, end = grow(same, int(at))
            if end > start and same[start:end].sum() >= IDENTITY * (end - start):
                out.append((start, end))
    return out


def leaks(block: TestBlock, ids: np.ndarray) -> Iterator[Leak]:
    """One leak for each leaked item of the block."""
    for item, diagonals in block.candidates(ids):
        own, spans = block.items[item][1], []
        for kind, on in patterns(own, ids, diagonals).items():
            same = np.unpackbits(np.frombuffer(kind, np.uint8), count=len(own)).astype(bool)
            on = np.concatenate(on)
            spans += [(int(same[s:e].sum()), s, on, same[s:e]) for s, e in stretches(same)]
        if not spans:
            continue
        n, at, on, same = max(spans, key=lambda s: (s[0], -int(s[2][0])))
        main, seen = int(on[0]), np.zeros(len(own), bool)
        for _, s, of, equal in spans:
            if (np.abs(of - main) <= max(SHIFT, len(own) // 4)).any():
                seen[s : s + len(equal)] |= equal
        covered = seen.sum() / len(own)
        if n >= min(MIN_MATCH, np.ceil(0.8 * len(own))) or covered >= MIN_COVER:
            yield Leak(item, at + main, at + main + len(same), n, float(covered))


def blocks(benchmark: DataFrame, key: str, text: str, most: int = BLOCK_HASHES) -> Iterator[TestBlock]:
    """The benchmark in blocks of at most about ``most`` hashes, read one partition at a time."""
    now, held = TestBlock(), 0
    for r in benchmark.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        words = tokens(r["t"])
        if len(words) < MIN_ITEM:
            continue
        if held and held + len(words) * len(MASKS) > most:
            yield now.close()
            now, held = TestBlock(), 0
        now.add(r["k"], words)
        held += len(words) * len(MASKS)
    if held:
        yield now.close()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = BLOCK_HASHES
) -> DataFrame:
    """doc_id, item_id, start, end (tokens of the document), n_match, coverage for every leaked item of every row."""
    spark, out = docs.sparkSession, None
    kind = "doc_id long, item_id long, start long, end long, n_match long, coverage double"
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    small_batches(spark)
    for block in blocks(benchmark, item, item_text, most):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value.vocabulary.get
            for b in batches:
                found = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = np.array([known(w, 0) for w in tokens(t)], np.int64)
                    found += [(k, held.value.items[x.item][0], x.start, x.end, x.matched, x.covered) for x in leaks(held.value, ids)]
                cols = list(zip(*found, strict=True)) or [[]] * 6
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "start", "end", "n_match", "coverage"])

        part = rows.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], kind) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", most: int = BLOCK_HASHES) -> DataFrame:
    """The rows that leak no item, all columns as they were; no shuffle."""
    small_batches(docs.sparkSession)
    schema, at = docs.schema, place(docs, text)
    for block in blocks(benchmark, benchmark.columns[0], item_text, most):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def sift(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value.vocabulary.get
            for b in batches:
                ids = (np.array([known(w, 0) for w in tokens(t)], np.int64) for t in b.column(at).to_pylist())
                yield b.filter(pa.array([next(leaks(held.value, x), None) is None for x in ids], pa.bool_()))

        docs = docs.mapInArrow(sift, schema)
    return docs
