"""SimHash near-duplicates with BK-trees.

Fingerprints (64 bits) link when few bits differ; equal ones are one member. By the pigeonhole principle two within the
radius agree on some choice of blocks of bits, so each member belongs to the shard of every choice's value. A shard is a
BK-tree (``bktree.py``; a large one, several), grown in the task that holds its rows. All trees are broadcast while they
are within ``BROADCAST_BYTES``, and the members, wherever they lie, ask the trees of their shards and follow the edges
within the radius. Beyond that size the members of a shard, or of every two parts of a large one, meet in a task, which
grows the same tree and asks it. Either way a task returns stars that join what its links join, one link a member at
most, and their connected components are those of all links.

``keep_one`` links texts of a similarity (Jaccard, on sets of word shingles) of ``SIMILAR`` and more. Fingerprints of
such texts differ in up to ``WIDE`` bits, too many for blocks of bits to shard by. There a shard holds the texts that
have a band of minima of their shingles' hashes in common, and its BK-tree links those within ``WIDE`` bits (here of
fingerprints in which a shingle counts once, as in the similarity). What such links join is a loose group; inside one,
texts are compared on their whole sets of shingles, and that alone decides. So no link below ``SIMILAR`` is taken; two
texts at 0.8 are in no common group with a chance of about 0.5 % at most (0.2 % have no common band, 0.3 % differ in more
bits), and more alike ones more rarely. A loose group too large for a task is dealt by its shards again.

Defined results: a null or empty text, or one of blanks, has fingerprint 0 and links as any other (``keep_one``: all
such texts are one group); a text shorter than a shingle is one shingle; equal rows share a component; a component's id
is its smallest id, nulls aside (null if it has no other); an empty table gives an empty result. Ids are of any type
that Spark orders. Other columns are not read by ``near_duplicates`` and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ._common import cut, free_name, small_batches
from .bktree import Trees, merge

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members of a shard that unlike fingerprints fill, on average; members, and bytes of sets, of a tree or a task.
SHARD, PART, PART_BYTES = 128, 4096, 64 << 20
#: Trees are broadcast up to this size; of a member: fingerprint, node, parent, edge, tree, and a place among children.
BROADCAST_BYTES, NODE_BYTES = 64 << 20, 48
#: A component that many fingerprints look up is read in so many places.
SALTS = 16
#: A fingerprint that more than one in so many rows has is hot; there are fewer than so many.
HOT = 1000
#: Questions that a task asks broadcast trees at a time.
ASKED = 1 << 16
#: Of keep_one: words of a shingle, similarity, radius; bands of so many minima of a text's shingles.
WORDS, SIMILAR, WIDE = 5, 0.8, 18
BANDS, ROWS = 12, 4
MINIMA = BANDS * ROWS


def hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of the text's shingles, in order; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, lower() and split() know ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    digest, stops = xxhash.xxh64_intdigest, (ends[width - 1 :] - 1).tolist()
    return np.array([digest(whole[s:e], SEED) for s, e in zip(starts, stops, strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; a long text's are counted in pieces."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of the text; a shingle counts as often as it occurs."""
    return majority(hashes(text, width))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, also: Sequence[str] = ()) -> DataFrame:
    """``key``, the columns ``also`` and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    small_batches(docs.sparkSession)
    held = docs.select(F.col(f"`{key}`").alias(key), *also)
    rows = docs.select(F.col(f"`{key}`").alias(key), *also, F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, held.schema.add("fp", "long"))


def choices(n: int, radius: int) -> list[int]:
    """Masks of bits such that two values within the radius agree under one of them. The more fingerprints there are,
    the more bits a mask has, which keeps shards of unlike fingerprints at about ``SHARD`` members: the work changes,
    the links do not."""
    wanted, agree = max(1, ceil(log2(max(2, n / SHARD)))), 1
    while agree < 4 and 64 * agree / (radius + agree) < wanted:
        agree += 1
    blocks, each = radius + agree, ceil(wanted / agree)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [sum(1 << j for j in range(edges[i], min(edges[i + 1], edges[i] + each))) for i in range(blocks)]
    return [sum(bits[i] for i in own) for own in combinations(range(blocks), agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal(members: DataFrame, node: str, parts: Column) -> DataFrame:
    """Members (c, v, the node and others) by task: part p of a shard meets part q in task (p, q), p <= q, and so each
    pair of parts meets once."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j")))
    placed = members.withColumn("m", parts.cast("int")).withColumn("p", F.pmod(F.xxhash64(node, "c"), "m").cast("int"))
    return placed.select(*members.columns, "p", F.inline(pairs).alias("i", "j"))


def in_tasks(dealt: DataFrame, find: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """a, b: what ``find`` returns for the columns of each task's rows. Rows come sorted by task; a task's rows are
    searched when they are whole."""
    keys, columns = ["c", "v", "i", "j"], dealt.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}

        def found(ends: list[int]) -> pd.DataFrame:
            whole, out, s = {c: np.concatenate(x) for c, x in held.items()}, [], 0
            for e in ends:
                out.append(find({c: x[s:e] for c, x in whole.items()}))
                s = e
            held.update({c: [x[s:]] for c, x in whole.items()})
            return pd.DataFrame({"a": np.concatenate([x[0] for x in out]), "b": np.concatenate([x[1] for x in out])})

        for x in batches:
            if not len(x):
                continue
            key = {c: x[c].to_numpy() for c in keys}
            last = [held[c][-1][-1:] if held else key[c][:1] for c in keys]
            new = np.any([np.concatenate([y, key[c]])[1:] != np.concatenate([y, key[c]])[:-1] for c, y in zip(keys, last, strict=True)], axis=0)
            before = sum(map(len, held.get("c", [])))
            for c in columns:
                held.setdefault(c, []).append(x[c].to_numpy())
            if new.any():
                yield found((np.flatnonzero(new) + before).tolist())
        if n := sum(map(len, held.get("c", []))):
            yield found([n])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def meet(x: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of one task of ``deal``: part i's tree, asked by part j (or by itself)."""
    fp, mine = x["fp"].view(np.uint64), x["p"] == x["i"][0]
    of_tree = np.flatnonzero(mine)
    of_asked = of_tree if x["i"][0] == x["j"][0] else np.flatnonzero(~mine)
    trees = Trees.build(fp[of_tree], x["fp"][of_tree], np.zeros(len(of_tree), np.int64))
    if not len(of_tree):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return trees.linked(fp[of_asked], x["fp"][of_asked], np.zeros(len(of_asked), np.int64), radius)


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trees of rows (c, v, p, fp) that come sorted: each member with its parent's distance above it in the tree's
    rows (0: a root) and its edge. A shard's part is a tree; it is grown when its rows are whole."""
    left: pa.Table | None = None

    def out(t: pa.Table) -> pa.RecordBatch:
        c, v, p, fp = (t.column(i).to_numpy() for i in range(4))
        new = np.concatenate([[False], (c[1:] != c[:-1]) | (v[1:] != v[:-1]) | (p[1:] != p[:-1])])
        trees = Trees.build(fp.view(np.uint64), fp, np.cumsum(new))
        up = np.where(trees.parent < 0, 0, np.arange(len(fp)) - trees.parent)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c, v, p, fp, up.astype(np.int32), trees.edge.astype(np.int32))], names=["c", "v", "p", "fp", "up", "edge"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t])
        c, v, p = (t.column(i).to_numpy() for i in range(3))
        ends = np.flatnonzero((c[1:] != c[:-1]) | (v[1:] != v[:-1]) | (p[1:] != p[:-1]))
        whole = int(ends[-1]) + 1 if len(ends) else 0
        if whole:
            yield out(t.slice(0, whole))
        left = t.slice(whole)
    if left is not None and left.num_rows:
        yield out(left)


class Grove:
    """Trees of many shards, to be broadcast: found by choice and value."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("c", "ascending"), ("v", "ascending"), ("p", "ascending")])  # keeps the order in a tree
        c, v, p, fp, up, edge = (rows.column(i).to_numpy() for i in range(6))
        new = np.concatenate([[False], (c[1:] != c[:-1]) | (v[1:] != v[:-1]) | (p[1:] != p[:-1])])[: len(c)]
        self.trees = Trees(fp.view(np.uint64), fp, np.cumsum(new), np.where(up == 0, -1, np.arange(len(fp)) - up), edge.astype(np.int16))
        at = self.trees.start
        self.choice, self.value = c[at], v[at]

    def ask(self, c: np.ndarray, v: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        asks, tree = [], []
        for choice in np.unique(c):
            own = np.flatnonzero(c == choice)
            lo, hi = np.searchsorted(self.choice, choice), np.searchsorted(self.choice, choice, "right")
            a, b = (lo + np.searchsorted(self.value[lo:hi], v[own], side) for side in ("left", "right"))
            asks.append(np.repeat(own, b - a))
            tree.append(np.repeat(a, b - a) + np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a))
        if not asks:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, t = np.concatenate(asks), np.concatenate(tree)
        return self.trees.linked(fp[q].view(np.uint64), fp[q], t, radius)


def shard_links(members: DataFrame, radius: int, part: int | None = None, most: int | None = None) -> DataFrame:
    """a, b: stars that join the fingerprints that links within the radius join, inside the shards (c, v) of ``members``
    (c int, v long, fp long, without repeats)."""
    part, most = part or PART, BROADCAST_BYTES if most is None else most
    sizes = cut(members.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    own = members.join(sizes, ["c", "v"])
    if total * NODE_BYTES > most:
        return in_tasks(deal(own, "fp", F.ceil(F.col("n") / part)), lambda x: meet(x, radius)).distinct()
    parted = own.select("c", "v", F.pmod(F.xxhash64("fp", "c"), F.ceil(F.col("n") / part)).cast("int").alias("p"), "fp")
    trees = parted.repartition("c", "v", "p").sortWithinPartitions("c", "v", "p", "fp").mapInArrow(grown, "c int, v long, p int, fp long, up int, edge int")
    held = members.sparkSession.sparkContext.broadcast(Grove(trees.toArrow()))  # at most ``most`` bytes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch:
            a, b = held.value.ask(*(np.concatenate([x.column(i).to_numpy() for x in some]) for i in range(3)), radius)
            some.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            some.append(b)
            if sum(x.num_rows for x in some) >= ASKED:
                yield found()
        if some:
            yield found()

    return members.select("c", "v", "fp").mapInArrow(ask, "a long, b long").distinct()


def links(fps: DataFrame, radius: int = RADIUS, part: int | None = None, most: int | None = None) -> DataFrame:
    """a, b: stars that join what the links between the distinct fingerprints ``fp`` of ``fps`` join."""
    fps = cut(fps.select("fp").distinct())
    masks = choices(fps.count(), radius)
    shards = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for i, m in enumerate(masks)])
    return shard_links(fps.select(F.inline(shards).alias("c", "v"), "fp"), radius, part, most)


@cache
def factors() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(SEED).integers(0, 1 << 63, (2, MINIMA), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def minima(h: np.ndarray) -> np.ndarray:
    """Smallest values (uint32) of the distinct hashes under ``MINIMA`` fixed multiply-shift functions."""
    (a, b), out = factors(), np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        out = np.minimum(out, ((h[i : i + 512, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(0))
    return out


def sketches(docs: DataFrame, also: Sequence[str], text: str, width: int = WORDS) -> DataFrame:
    """The columns ``also``, and of every text: sid (a hash of its set of shingles), n (their number), fp, and bands
    (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, n, fp, bands = [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                u = np.unique(hashes(t, width))
                m = minima(u)
                n.append(len(u))
                fp.append(signed(majority(u)))  # of the set, as the minima: repeats are no part of the similarity
                sid.append(signed(xxhash.xxh64_intdigest(u.tobytes(), SEED)))
                bands.append([signed(xxhash.xxh64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)])
            new = [pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], "sid", "n", "fp", "bands"])

    small_batches(docs.sparkSession)
    schema = docs.select(*also).schema.add("sid", "long").add("n", "long").add("fp", "long").add("bands", T.ArrayType(T.LongType()))
    return docs.select(*also, F.col(text).alias("_text")).mapInArrow(run, schema)


def with_sets(texts: DataFrame, width: int = WORDS) -> DataFrame:
    """``texts`` (its last column: the text) with that text's set of shingles, as sorted hashes in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(hashes(t, width)).tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], names=[*b.schema.names[:-1], "set"])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, texts.drop(texts.columns[-1]).schema.add("set", "binary"))


def alike(x: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the sids of one task of ``deal`` (i, j, p, sid, set) whose sets have the least similarity. Common shingles
    are counted through lists of the members that hold a shingle, so a text costs what it shares with others."""
    n, mine = len(x["sid"]), x["p"] == x["i"][0]
    of_tree = np.flatnonzero(mine)
    of_asked = of_tree if x["i"][0] == x["j"][0] else np.flatnonzero(~mine)
    if not len(of_tree) or not len(of_asked) or n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sets = [np.frombuffer(s, np.uint64) for s in x["set"]]
    size = np.array([len(s) for s in sets])
    known, at = np.unique(np.concatenate([sets[m] for m in of_tree]), return_inverse=True)
    holds = np.repeat(np.arange(len(of_tree)), size[of_tree])[np.argsort(at, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(known)))])
    label = np.arange(n)
    for a in of_asked:
        if (label[of_tree] == label[a]).all():
            continue
        own = np.searchsorted(known, sets[a])
        own = own[known[np.minimum(own, len(known) - 1)] == sets[a]] if len(known) else own
        held = first[own + 1] - first[own]
        each = np.arange(int(held.sum())) + np.repeat(first[own] - (np.cumsum(held) - held), held)
        both = np.bincount(holds[each], minlength=len(of_tree))
        close = of_tree[both >= least * np.maximum(1, size[a] + size[of_tree] - both) - 1e-9]
        close = close[label[close] != label[a]]
        if len(close):
            label = merge(label, np.full(len(close), a), close)
    out = np.flatnonzero(label != np.arange(n))
    return x["sid"][out], x["sid"][label[out]]


def similar_links(texts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float = SIMILAR, radius: int = WIDE, part: int | None = None) -> DataFrame:
    """a, b: stars that join what the links between the distinct ``sid`` of ``texts`` (sid, n, fp, bands) join.
    ``sets_of`` appends the set to some of them."""
    part = part or PART
    members = texts.select(F.posexplode("bands").alias("c", "v"), "fp").distinct()
    loose = components(shard_links(members, radius, part))
    rooted = texts.join(loose.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tasks = lambda n, size: F.greatest(F.ceil(F.col(n) / part), F.ceil(8 * F.col(size) / PART_BYTES))
    groups = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("in_group"), F.sum("n").alias("shingles")).where("in_group > 1")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a large group is read in several tasks
    salt = F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")
    close = cut(rooted.withColumn("salt", salt).join(salted, ["root", "salt"]).drop("salt").withColumn("m", tasks("in_group", "shingles")).drop("in_group", "shingles"))
    small = close.where("m = 1").select(F.lit(-1).alias("c"), F.col("root").alias("v"), "sid", F.lit(1).alias("parts"))
    large = close.where("m > 1").select(F.posexplode("bands").alias("c", "v"), "sid", "n")
    counts = large.groupBy("c", "v").agg(F.count(F.lit(1)).alias("in_shard"), F.sum("n").alias("shingles")).where("in_shard > 1")
    large = large.join(counts, ["c", "v"]).select("c", "v", "sid", tasks("in_shard", "shingles").alias("parts"))
    placed = small.unionByName(large).join(sets_of(close), "sid")
    return in_tasks(deal(placed, "sid", F.col("parts")).drop("parts"), lambda x: alike(x, least)).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``key``, fingerprint (16 hex digits), component_id (the smallest key in reach) of every row."""
    rows = cut(fingerprints(docs, key, text, width))
    each = rows.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n"))
    joined = components(links(each, radius))
    linked = cut(joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct()).join(each.withColumnRenamed("fp", "node"), "node"))
    # Only linked fingerprints look up their component, one of a few salts of it: a large one is read by several tasks.
    tops = linked.groupBy("root").agg(F.min("least").alias("top")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(tops, ["root", "salt"]).select(F.col("node").alias("fp"), "top")
    named = cut(each.join(of, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id"), "n"))
    # Fingerprints that many rows share are broadcast, at most ``HOT`` of them; rows of the others meet theirs by a shuffle.
    hot = F.col("n") * HOT > rows.count()
    known, others = F.broadcast(named.where(hot).drop("n")), named.where(~hot).drop("n")
    out = rows.join(known, "fp").unionByName(rows.join(known, "fp", "left_anti").join(others, "fp"))
    return out.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, least: float = SIMILAR, radius: int = WIDE) -> DataFrame:
    """The rows that stay: of each group of texts that links of a similarity of ``least`` and more connect, one row with
    the smallest key (a null key only where there is no other; of several texts with that key, the one whose hash is
    smallest), all columns as they were."""
    k, h = F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))
    rows = cut(sketches(docs.select(k.alias("k"), h.alias("h"), F.col(f"`{text}`").alias("t")), ["k", "h"], "t", width))
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("least")
    texts = cut(rows.groupBy("sid").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), first))

    def sets_of(some: DataFrame) -> DataFrame:
        """One row of each sid is read again, and more only where it repeats in full."""
        asked = some.select("sid", F.col("least.k").alias("_k"), F.col("least.h").alias("_h"))
        given = docs.select(k.alias("k"), h.alias("h"), F.col(f"`{text}`").alias("t"))
        found = given.join(asked, given["k"].eqNullSafe(asked["_k"]) & (given["h"] == asked["_h"])).select("sid", "t")
        return with_sets(found, width).dropDuplicates(["sid"])

    joined = components(similar_links(texts, sets_of, least, radius))
    roots = texts.join(joined, texts["sid"] == joined["node"], "left").select(F.coalesce("root", "sid").alias("root"), "least")
    stay = cut(roots.groupBy("root").agg(F.min("least").alias("least")).select("least.k", "least.h"))
    twice = cut(rows.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(stay, ["h"]).where(rows["k"].eqNullSafe(stay["k"])).select(rows["k"], "h").distinct())
    own_k, own_h = free_name(docs, "_k"), free_name(docs, "_h")
    own = docs.withColumns({own_k: k, own_h: h})
    match = lambda t: (own[own_k].eqNullSafe(t["k"])) & (own[own_h] == t["h"])
    once = stay.alias("s").join(twice.alias("w"), F.col("s.h").eqNullSafe(F.col("w.h")) & F.col("s.k").eqNullSafe(F.col("w.k")), "left_anti")
    out = own.join(once, match(once), "left_semi").drop(own_k, own_h)
    if not twice.isEmpty():  # rows that repeat in full; one of them stays, combined before the shuffle
        cols = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        again = own.join(twice, match(twice), "left_semi").groupBy(own_k, own_h).agg(F.first(cols).alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out
