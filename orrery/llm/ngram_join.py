"""Jaccard join of sets of word shingles, by PartEnum signatures.

Two sets of sizes a and b with a similarity of at least ``percent`` / 100 differ in at most

    H(a, b) = floor((a + b) * (100 - percent) / (100 + percent))

shingles. Sizes fall into bands, each up to 100 / ``percent`` times its start, so similar sets lie in one band or in
neighbouring ones, and a set is signed for its own band and, where its partners reach it, for the next. In a band the
domain of shingles (their 64-bit hashes) is cut into parts of ``PARTS`` adjacent ranges each. The signatures of a set are
its shingles in every subset of ``PARTS`` - 1 ranges of every part. A difference spoils two of the three signatures of its
part, a second one in the part the third; so H differences over m parts spoil at most min(2 H, m + H) of the 3 m
signatures, and there are parts enough that this is not all of them.

That leaves a choice. Order signatures by what they hold (more shingles first, then by value): before the first one
that two similar sets have in common, a set has only spoiled ones. So min(2 H, m + H) + 1 signatures of each set, the
first in that order, are enough, and empty or nearly empty ranges, which unlike sets share, are hardly ever among them.

Rows of signatures are sorted in tasks. A bucket (the sets that share a signature) gives candidates: a small one its
pairs, a large one (``BUCKET``) a star first. Once these links are known, tasks seek pairs of different components in large
buckets: a first pass gives the sets that have one, a second, which holds these sets whole, compares them and gives the
links that join components, so that neither gives more rows than a task has. Candidates pass a parity sketch (bits of a sketch that differ never outnumber the shingles
that do), and sets that do are compared whole. No candidate is dropped otherwise: every link is found that is needed to
join a component, and ``n_links`` is counted inside components, whose parts meet in tasks.

Shingles are told apart by 64-bit hashes, and sets by a 64-bit hash of those.

Defined results: a null or empty text, or one of blanks, has no shingles and is its own component without links; a text
of fewer words than a shingle is one shingle; texts with equal sets are one set, linked with each other; equal rows
count as documents of their own; a component's id is its smallest id, nulls aside (null if it has no other); an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import bloom
from ._common import HOT, cut, look_up, small_batches
from .simhash import SEED, deal, in_tasks, signed

WORDS, PERCENT = 5, 80
#: Ranges of a part.
PARTS = 3
#: Parts beyond the fewest that do, in percent: more of them leave more weak signatures out, but hold less each.
MORE = 15
#: Sets of a bucket whose pairs are listed; sets, and bytes of sets, of a task.
BUCKET, TASK, TASK_BYTES = 32, 4096, 64 << 20
#: Smallest signatures of large buckets that a node is listed with, which tell where a pair is compared.
SMALLEST = 64
#: Signatures that a task gathers before it passes them on, and rows of them that it looks through at a time.
GATHERED, SORTED = 1 << 20, 1 << 16
#: Up to so many nodes, a filter (64 MB then) spares the shuffle of other texts.
FILTERED = 1 << 25
#: Ranges of sets that are signed at a time.
CELLS = 1 << 18
#: A sketch has at least so many bits for each shingle in which similar sets may differ.
SKETCH_BITS = 8

MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)]


def differing(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The most shingles in which similar sets of ``total`` shingles together differ."""
    return total * (100 - percent) // (100 + percent)


@cache
def bands(percent: int, up_to: int) -> list[int]:
    """Largest sizes of the bands, until one is at least ``up_to``."""
    tops = [100 // percent]
    while tops[-1] < up_to:
        tops.append((tops[-1] + 1) * 100 // percent)
    return tops


@cache
def edges(top: int, percent: int) -> tuple[int, np.ndarray]:
    """Parts of a band, and the first hash of each of their ranges but the first."""
    fewest = differing(2 * top, percent) // 2 + 1
    parts = -(-fewest * (100 + MORE) // 100)
    n = PARTS * parts
    return parts, np.array([-(-(i << 64) // n) for i in range(1, n)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[0]
    x = (x ^ (x >> np.uint64(33))) * MIX[1]
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the text's different shingles, mixed from its words' hashes in their order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, lower() and split() know ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = min(width, len(each))
    last = len(each) - n + 1
    h = each[:last] + np.uint64(n)
    for i in range(1, n):
        h = (h ^ (h >> np.uint64(32))) * MIX[2] + each[i : last + i]
    h = np.sort(mixed(h))
    return h[np.append(True, h[1:] != h[:-1])]


def band_signatures(sets: list[np.ndarray], top: int, percent: int) -> list[np.ndarray]:
    """Signatures of sets (sorted hashes, none empty) for one band, of each as many as are needed."""
    parts, starts = edges(top, percent)
    n, ranges = np.array([len(u) for u in sets]), np.uint64(parts * PARTS)
    u, low = np.concatenate(sets), np.uint64(32)
    of = ((u >> low) * ranges + (((u & np.uint64(0xFFFFFFFF)) * ranges) >> low)) >> low  # the range of a hash: the starts that it has reached
    cell = np.repeat(np.arange(len(sets)) * parts * PARTS, n) + of.astype(np.int64)
    size = np.bincount(cell, minlength=len(sets) * parts * PARTS)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(u, dtype=np.uint64)])
    ends = np.cumsum(size)
    held, size = (sums[ends] - sums[ends - size]).reshape(-1, parts, PARTS), size.reshape(-1, parts, PARTS)
    where = np.arange(parts * PARTS, dtype=np.uint64).reshape(parts, PARTS) * MIX[2] + np.uint64(top)
    # The signature that leaves range d out: what the other two hold, in their order, and where they are.
    first, second = held[:, :, [1, 0, 0]], held[:, :, [2, 2, 1]]
    values = mixed(mixed(first + where) * MIX[2] + second + where).reshape(len(sets), -1)
    counts = (size.sum(2)[:, :, None] - size).reshape(len(sets), -1)
    most = differing(n + np.minimum(n * 100 // percent, top), percent)
    found = []
    for value, count, wanted in zip(values, counts, np.where(most > 0, np.minimum(2 * most, parts + most) + 1, 0).tolist(), strict=True):
        if not wanted:  # only an equal set is similar
            found.append(value[:0])
        elif wanted >= len(value):
            found.append(value)
        else:
            least = np.partition(count, len(count) - wanted)[len(count) - wanted]
            more = value[count > least]
            found.append(np.concatenate([more, np.sort(value[count == least])[: wanted - len(more)]]))
    return found


def signatures_of(sets: list[np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """Signatures of each set (sorted hashes) for its own band and, where its partners reach it, the next. Sets of a band
    are signed together."""
    found: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in sets]
    of: dict[int, list[int]] = {}
    for i, n in enumerate(map(len, sets)):
        if n:
            tops = bands(percent, 1 << (2 * n).bit_length())
            own = bisect_left(tops, n)
            for top in tops[own : own + 1 + (n * 100 // percent > tops[own])]:
                of.setdefault(top, []).append(i)
    for top, rows in of.items():
        step = max(1, CELLS // (PARTS * edges(top, percent)[0]))
        for k in range(0, len(rows), step):
            for i, x in zip(rows[k : k + step], band_signatures([sets[i] for i in rows[k : k + step]], top, percent), strict=True):
                found[i].append(x)
    return [np.concatenate(x) for x in found]


def signatures(u: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return signatures_of([u], percent)[0]


def sketch(u: np.ndarray, percent: int = PERCENT) -> bytes:
    """Parities of how many hashes end in the same bits."""
    bits = 1 << max(6, (SKETCH_BITS * int(differing(2 * len(u), percent)) - 1).bit_length())
    return np.packbits(np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch as one of ``size`` bytes: its own halves, one over the other."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_be_similar(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """False only for sets (by sketches and sizes) that are not similar."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    size = min(len(a), len(b))
    x, y = (folded(np.frombuffer(s, np.uint8), size) for s in (a, b))
    return int(np.bitwise_count(x ^ y).sum()) <= differing(n + m, percent)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted hashes) are similar."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def with_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, set of rows (node, t): the text's set of shingles, as sorted hashes in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def node_of(u: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(u.tobytes(), SEED))


def described(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """k, h, node (a hash of the set; null without shingles), n (its size) and bits (its sketch) of rows (k, h, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(2).to_pylist()]
            new = [
                pa.array([node_of(u) if len(u) else None for u in sets], pa.int64()),
                pa.array([len(u) for u in sets], pa.int64()),
                pa.array([sketch(u, percent) if len(u) else None for u in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *new], names=["k", "h", "node", "n", "bits"])

    return texts.mapInArrow(run, texts.select("k", "h").schema.add("node", "long").add("n", "long").add("bits", "binary"))


def signed_lists(texts: DataFrame, width: int, percent: int, groups: int, skip: frozenset[int] = frozenset()) -> DataFrame:
    """g, sig, node: signatures and nodes of the sets of texts (t), without the nodes to ``skip``, as lists of those with
    the same first bits g (``groups`` of them, a power of two)."""
    shift = np.uint64(65 - groups.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        nodes: list[int] = []

        def out() -> pa.RecordBatch:
            sig = np.concatenate(sigs)
            node = np.repeat(np.array(nodes, np.int64), [len(s) for s in sigs])
            group = (sig >> shift).astype(np.int32)
            order = np.argsort(group, kind="stable")
            own, starts = np.unique(group[order], return_index=True)
            ends = pa.array(np.append(starts, len(sig)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (sig.view(np.int64), node)]
            sigs.clear()
            nodes.clear()
            return pa.RecordBatch.from_arrays([pa.array(own), *lists], names=["g", "sig", "node"])

        held = 0
        for b in batches:
            sets = [u for t in b.column(0).to_pylist() if len(u := shingle_set(t, width))]
            own = [node_of(u) for u in sets]
            kept = [i for i, node in enumerate(own) if node not in skip]
            for node, s in zip([own[i] for i in kept], signatures_of([sets[i] for i in kept], percent), strict=True):
                if len(s):
                    sigs.append(s)
                    nodes.append(node)
                    held += len(s)
                    if held >= GATHERED:
                        yield out()
                        held = 0
        if sigs:
            yield out()

    return texts.select("t").mapInArrow(run, "g int, sig array<long>, node array<long>")


def met(lists: DataFrame) -> DataFrame:
    """What the signatures in ``lists`` bring together. Of a signature of at most ``BUCKET`` nodes, its pairs (a < b, no
    sig); of a larger one, its nodes (sig, a). Rows come sorted; a task holds some of them and one small bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        s, x, large = np.empty(0, np.int64), np.empty(0, np.int64), False  # the last bucket, still open; of a large one, its last row

        def out(end: bool) -> pa.RecordBatch:
            nonlocal s, x, large
            before = int(large)  # rows that were passed on already
            s, x = (np.concatenate([old, *[b.column(i).to_numpy() for b in held]]) for i, old in enumerate((s, x)))
            held.clear()
            own = np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])])
            s, x = s[own], x[own]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(starts, len(s)))
            big = size > BUCKET
            big[0] |= large
            open_ = 0 if end or big[-1] else int(size[-1])  # an open small bucket waits
            bucket, many = np.repeat(np.arange(len(size)), size), np.repeat(big, size)
            n = len(s) - open_
            lone = np.arange(n)[many[:n]][before:] if before else np.flatnonzero(many[:n])
            firsts, seconds = [], []
            for d in range(1, BUCKET):
                i = np.flatnonzero((bucket[: max(0, n - d)] == bucket[d:n]) & ~many[: max(0, n - d)])
                if not len(i):
                    break
                firsts.append(x[i])
                seconds.append(x[i + d])
            pairs = sum(map(len, firsts))
            a = pa.array(np.concatenate([*firsts, x[lone]]))
            b = pa.array(np.concatenate([*seconds, np.zeros(len(lone), np.int64)]), mask=np.arange(pairs + len(lone)) >= pairs)
            sig = pa.array(np.concatenate([np.zeros(pairs, np.int64), s[lone]]), mask=np.arange(pairs + len(lone)) < pairs)
            large = bool(big[-1])
            s, x = (s[-1:], x[-1:]) if large else (s[n:], x[n:])
            return pa.RecordBatch.from_arrays([a, b, sig], names=["a", "b", "sig"])

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= SORTED:
                yield out(False)
                rows = 0
        if held or len(s):
            yield out(True)

    rows = lists.repartition("g").select(F.inline(F.arrays_zip("sig", "node"))).sortWithinPartitions("sig", "node")
    return rows.mapInArrow(run, "a long, b long, sig long")


def pairs_of(links: DataFrame) -> DataFrame:
    """Links (a, b) of different nodes, each once, the smaller node first."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs with the columns of both nodes, as <column>_a and <column>_b."""
    for side in "ab":
        own = table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(own, side)
    return pairs.select("a", "b", *[f"{c}_{s}" for c in columns for s in "ab"])


def kept_pairs(rows: DataFrame, keep: Callable[..., bool]) -> DataFrame:
    """a, b of the rows whose further columns ``keep`` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = [keep(*x) for x in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def sketched(pairs: DataFrame, each: DataFrame, percent: int) -> DataFrame:
    return kept_pairs(with_both(pairs, each, "bits", "n"), lambda a, b, n, m: may_be_similar(a, b, n, m, percent))


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return kept_pairs(with_both(pairs, sets, "set"), lambda a, b: similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent))


def sides(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two parts that meet in a task, and whether they are one."""
    mine, one = x["p"] == x["i"][0], bool(x["i"][0] == x["j"][0])
    own = np.flatnonzero(mine)
    return own, own if one else np.flatnonzero(~mine), one


def apart(x: dict[str, np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a task's rows (node, root, n, bits, sigs) each asked one and those in other components that it may be similar to
    by their sketches. A pair of which both lists of signatures have a smaller one than the task's is left to that one."""
    own, asked, one = sides(x)
    if not len(own) or not len(asked):
        return
    size = min(map(len, x["bits"]))
    bits = np.array([folded(np.frombuffer(s, np.uint8), size) for s in x["bits"]]).view(np.uint64)
    smaller = [s[s < x["v"][0]] for s in x["sigs"]]
    for i in asked:
        other = own[x["root"][own] != x["root"][i]]
        if one:
            other = other[x["node"][other] > x["node"][i]]
        n, m = x["n"][i], x["n"][other]
        other = other[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
        other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(1) <= differing(n + x["n"][other], percent)]
        if len(other) and len(smaller[i]):
            lists = [smaller[k] for k in other]
            met = np.isin(np.concatenate(lists), smaller[i])
            other = other[np.bincount(np.repeat(np.arange(len(other)), [len(s) for s in lists])[met], minlength=len(other)) == 0]
        if len(other):
            yield i, other


def doubtful(x: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a task that have a pair to compare, each once, with the task's signature."""
    found = [k for i, other in apart(x, percent) for k in (i, *other)]
    nodes = np.unique(x["node"][found]) if found else np.empty(0, np.int64)
    return nodes, np.full(len(nodes), x["v"][0])


def joining(x: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a task (rows also with set) that join two components, fewer than it has: sets of components that an
    earlier link of the task has joined are not compared again."""
    of = {r: r for r in x["root"].tolist()}

    def top(r: int) -> int:
        while of[r] != r:
            of[r] = r = of[of[r]]
        return r

    sets, roots, a, b = [np.frombuffer(s, np.uint64) for s in x["set"]], x["root"].tolist(), [], []
    for i, other in apart(x, percent):
        for k in other:
            p, q = top(roots[i]), top(roots[k])
            if p != q and similar(sets[i], sets[k], percent):
                of[max(p, q)] = min(p, q)
                a.append(x["node"][i])
                b.append(x["node"][k])
    return np.array(a, np.int64), np.array(b, np.int64)


def counted(x: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a task (node, copies, set), each with the documents of the sets similar to its own that it meets here.
    Common shingles are counted through lists of the sets that hold a shingle."""
    own, asked, one = sides(x)
    if not len(own) or not len(asked):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sets = [np.frombuffer(s, np.uint64) for s in x["set"]]
    size = np.array([len(s) for s in sets])
    known, at = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True)
    holds = np.repeat(np.arange(len(own)), size[own])[np.argsort(at, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(known)))])
    found = np.zeros(len(sets), np.int64)
    for i in asked:
        mine = np.searchsorted(known, sets[i])
        mine = mine[known[np.minimum(mine, len(known) - 1)] == sets[i]]
        n = first[mine + 1] - first[mine]
        every = np.arange(int(n.sum())) + np.repeat(first[mine] - (np.cumsum(n) - n), n)
        both = np.bincount(holds[every], minlength=len(own))
        close = own[(both > 0) & (100 * both >= percent * (size[i] + size[own] - both))]
        close = close[close != i]
        found[i] += x["copies"][close].sum()
        if not one:
            found[close] += x["copies"][i]
    return x["node"], found


def in_parts(members: DataFrame, group: str, weight: str, find: Callable) -> DataFrame:
    """What ``find`` returns for the tasks in which every two parts of a group of ``members`` meet; a group that fits
    into a task is one part. ``weight``: bytes of a member."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_bytes"))
    own = look_up(members, sizes, group, "_n")
    parts = F.greatest(F.ceil(F.col("_n") / TASK), F.ceil(F.col("_bytes") / TASK_BYTES))
    placed = own.select(F.lit(0).alias("c"), F.col(group).alias("v"), *[c for c in members.columns if c != group], parts.alias("_parts"))
    return in_tasks(deal(placed, "node", F.col("_parts")).drop("_parts"), find)


def stars(large: DataFrame) -> DataFrame:
    """a, b: of every large bucket (rows sig, node), each node and the one that is in the most large buckets: of copies
    changed in different places, that is the text that they were made of, if it is there."""
    often = large.groupBy("node").agg(F.count(F.lit(1)).alias("often"))
    heads = large.join(often, "node").groupBy("sig").agg(F.max(F.struct("often", "node"))["node"].alias("a"), F.count(F.lit(1)).alias("size"))
    return look_up(large, heads, "sig", "size").select("a", F.col("node").alias("b")).distinct()


def links_of(rows: DataFrame, each: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (as ``met`` returns them): links (a, b) whose components are those of all links, and the sets of the
    nodes in them. ``each``: node, n, bits. ``fetch``: a table of nodes to their sets (node, set)."""
    listed, large = rows.where("sig is null").select("a", "b"), rows.where("sig is not null").select("sig", F.col("a").alias("node"))
    none = large.isEmpty()
    close = cut(sketched(pairs_of(listed if none else listed.unionByName(stars(large))), each, percent))
    nodes = close.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    sets = cut(fetch(nodes))
    links = cut(compared(close, sets, percent))
    if none:
        return links, sets
    joined = components(links)
    rooted = large.select("sig", "node").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    mixed_ = look_up(rooted, open_.select("sig", "size"), "sig", "size").drop("size")
    lists = mixed_.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, SMALLEST).alias("sigs"))  # a node has a signature a shingle
    mixed_ = cut(mixed_.join(each.select("node", "n", "bits"), "node").join(lists, "node"))
    asked = in_parts(mixed_.withColumn("_weight", F.octet_length("bits")), "sig", "_weight", lambda x: doubtful(x, percent)).distinct()
    asked = mixed_.join(asked.select(F.col("a").alias("node"), F.col("b").alias("sig")), ["sig", "node"]).join(sets, "node")
    late = in_parts(cut(asked.withColumn("_weight", F.octet_length("set"))), "sig", "_weight", lambda x: joining(x, percent))
    return cut(links.unionByName(pairs_of(late))), sets


def join_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key``, n_shingles, component_id (the smallest key in reach) and n_links (documents directly linked with it) of
    every row."""
    spark = docs.sparkSession
    small_batches(spark)
    t = F.col(f"`{text}`")
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))
    rows = cut(described(texts, width, percent))
    least = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("least")
    each = cut(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies"), least))

    def texts_of(nodes: DataFrame) -> DataFrame:
        """node, t: the text of one row of each node. While a filter of the nodes' texts fits, only what it passes is
        shuffled; the join decides."""
        asked = cut(each.join(nodes, "node").select("node", F.col("least.k").alias("_k"), F.col("least.h").alias("_h")))
        n = asked.count()
        some = bloom.sifted(texts, bloom.built(asked.select(*bloom.hashes(F.col("_h"))), n), "h") if n <= FILTERED else texts
        found = some.join(asked, some["k"].eqNullSafe(asked["_k"]) & (some["h"] == asked["_h"]))
        return found.select("node", "t").dropDuplicates(["node"])

    # A set that many rows have is signed once; there are fewer than a thousand such sets.
    hot = frozenset(r["node"] for r in each.where(F.col("copies") * HOT > rows.count()).select("node").collect())
    groups = 1 << min(16, max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    lists = signed_lists(texts, width, percent, groups, hot)
    if hot:
        lists = lists.unionByName(signed_lists(texts_of(spark.createDataFrame([(x,) for x in hot], "node long")), width, percent, groups))
    links, sets = links_of(cut(met(lists)), each, lambda nodes: with_sets(texts_of(nodes), width), percent)

    joined = components(links)
    rooted = cut(joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct()).join(each.select("node", "n", "copies", "least"), "node"))
    tops = rooted.groupBy("root").agg(F.min("least.k").alias("top"), F.count(F.lit(1)).alias("_n"))
    members = rooted.select("root", "node", "copies", (8 * F.col("n")).alias("_weight")).join(sets, "node")
    near = in_parts(members, "root", "_weight", lambda x: counted(x, percent)).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("near"))
    of = look_up(rooted.select("root", "node"), tops, "root", "_n").select("node", "top").join(near, "node")
    named = cut(
        each.join(of, "node", "left").select(
            "node", "copies", F.coalesce("top", "least.k").alias("component_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
        )
    )
    own = look_up(rows.where("n > 0").select("k", "n", "node"), named, "node", "copies")
    none = rows.where("n = 0").select("k", "n", F.col("k").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return own.select("k", "n", "component_id", "n_links").unionByName(none).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")
