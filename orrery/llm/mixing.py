"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A row's size is its number of words. Targets share a budget by weight and stop at ``cap`` times a source's size; what
is cut off is shared again until no target is above. Each source's rows are hashed into blocks. A mix draws blocks:
every block once for each whole pass over the source, and for the rest blocks in a permuted order until the target is
reached; the last of them is cut, and of its rows those are taken that fill what is left best. The numbers of draws
are the source's exact quota of blocks.

The quotas are split over the output shards by a binary tree: a node's left half of shards draws its share of the
node's blocks without replacement, source by source as a multivariate hypergeometric variable with the node's own
seed, and the right half gets the others. A shard walks from the root to its leaf and knows its quotas, and also where
its draws begin in each source's permuted order, so shards are disjoint without talking to each other. Within a shard
rows come in hashed order.

Permuted orders are summed in two levels (buckets of about ``BUCKET`` blocks), so no task holds a source. All draws
depend on hashes and seeds alone: reruns agree.

Defined results: a null or empty text has size 0 and may be taken without counting; a null source is a source of its
own, after all others; rows that are equal in key, source and text are numbered, and drawn apart as others are; a source
without words has target 0; an empty table gives an empty mix. Other columns pass through ``Mix.rows_of``; names that would clash with
the appended ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ._common import cut, n_words

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, CAP = 1.5, 2.0
BLOCK_WORDS, SHARD_WORDS, BUCKET = 1 << 16, 1 << 20, 1024
#: Sources of one mix, at most: quotas of all sources are held by each tree walk.
MAX_SOURCES = 100_000
#: Blocks' draws are broadcast up to so many rows (of some 60 bytes), and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000


def unit(*cols: Column | str) -> Column:
    """A hash of the columns, in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def source_key(source: Column) -> Column:
    """A source as text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """``sizes``: skey, source, source_size. Appends rank, weight and target: the k-th source by code point (null last)
    has the k-th weight, which repeat."""
    n = sizes.count()
    if n > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources, this one has {n}; group them first")
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    given = F.array(*[F.lit(float(w)) for w in weights])
    s = cut(sizes.withColumn("rank", rank.cast("int")).withColumn("weight", F.element_at(given, F.col("rank") % len(weights) + 1)))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0) * budget
    most, level, above = F.lit(float(cap)) * F.col("source_size"), 0.0, -1
    while True:  # every step caps one source more, at least
        over = F.lit(level) * F.col("weight") > most
        x = s.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, most)).alias("stopped"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if x["n"] == above or not x["weight"]:
            break
        above, level = x["n"], (total - (x["stopped"] or 0.0)) / x["weight"]
    return s.withColumn("target", F.least(F.lit(level) * F.col("weight"), most))


def walk(shard: int, shards: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(quotas of the shard, number of its first draw) by source: from the root to the shard's leaf."""
    lo, hi, first, now = 0, shards, np.zeros_like(quotas), quotas
    while hi - lo > 1:
        mid = (lo + hi) // 2
        share = int(now.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(now, share, method="marginals")
        if shard < mid:
            now, hi = left, mid
        else:
            first, now, lo = first + left, now - left, mid
    return now, first


def fill(sizes: Sequence[int], room: float) -> list[bool]:
    """Which to take so that they fill the room: the largest first where they fit, then one more if that comes closer."""
    order, out = sorted(range(len(sizes)), key=lambda i: -sizes[i]), [False] * len(sizes)
    for i in order:
        if 0 < sizes[i] <= room:
            out[i], room = True, room - sizes[i]
    rest = [i for i in order if not out[i] and sizes[i] > 0]
    if rest and sizes[rest[-1]] - room < room:
        out[rest[-1]] = True
    return out


@dataclass
class Mix:
    sources: DataFrame  # skey, source, source_size, rank, weight, target, blocks, passes, rest
    rows: DataFrame  # key, skey, size, h, block: one for each input row
    draws: DataFrame  # skey, block, pass, cut, shard: one for each block that a shard draws
    taken: DataFrame  # skey, h: the rows that are taken of cut blocks
    repeats: DataFrame  # h: hashes of rows that are equal in key, source and text
    key: str
    text: str
    source: str
    seed: int

    def counts(self) -> DataFrame:
        """key, size, source_size, target and taken (words, repeats counted) of every input row."""
        times = self.draws.where("not cut").groupBy("skey", "block").agg(F.count(F.lit(1)).alias("times"))
        return (
            self.rows.join(times, ["skey", "block"], "left")
            .join(self.taken.withColumn("once", F.lit(1)), ["skey", "h"], "left")
            .join(F.broadcast(self.sources.select("skey", "source_size", "target")), "skey")  # at most MAX_SOURCES rows
            .select(
                self.key, "size", "source_size", "target",
                (F.col("size") * (F.coalesce("times", F.lit(0)) + F.coalesce("once", F.lit(0)))).cast("long").alias("taken"),
            )
        )

    def rows_of(self, docs: DataFrame) -> DataFrame:
        """The mix itself: the rows of ``docs`` as often as they are drawn, with ``shard``, by shard and shuffled in it."""
        few = F.broadcast if self.draws.count() <= BROADCAST_ROWS else lambda df: df
        kept = [c for c in docs.columns if c.lower() not in ("shard", "_skey", "_h", "_block", "_pass", "_cut", "_at")]
        held = docs.select(
            *[F.col(f"`{c}`") for c in kept],
            source_key(F.col(f"`{self.source}`")).alias("_skey"),
            row_hash(self.key, self.source, self.text, self.seed).alias("_h"),
        )
        held = apart(held, self.repeats, "_h")
        drawn = self.draws.select(F.col("skey").alias("_skey"), F.col("block").alias("_block"), F.col("pass").alias("_pass"), F.col("cut").alias("_cut"), "shard")
        once = self.taken.select(F.col("skey").alias("_skey"), F.col("h").alias("_h"), F.lit(True).alias("_once")).distinct()
        few_once = F.broadcast if self.taken.count() <= BROADCAST_ROWS else lambda df: df
        return (
            held.join(F.broadcast(self.sources.select(F.col("skey").alias("_skey"), "blocks")), "_skey")
            .withColumn("_block", block_of(F.col("_h"), F.col("blocks")))
            .drop("blocks")
            .join(few(drawn), ["_skey", "_block"])
            .join(few_once(once), ["_skey", "_h"], "left")
            .where(~F.col("_cut") | F.col("_once"))
            .withColumn("_at", F.xxhash64("_h", "_pass", F.lit(self.seed)))
            .repartition("shard")
            .sortWithinPartitions("shard", "_at")
            .select(*[F.col(f"`{c}`") for c in kept], F.col("shard").cast("int").alias("shard"))
        )


def row_hash(key: str, source: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{text}`"), F.lit(seed))


def apart(rows: DataFrame, repeats: DataFrame, h: str) -> DataFrame:
    """``rows``, where those whose hash ``h`` is among ``repeats`` get hashes of their own: the first keeps it, the k-th
    hashes it with k. Which of equal rows is the k-th is open. They are numbered over ranges, so a row of any number of
    copies is spread; rows of other hashes are not moved."""
    n = repeats.count()
    if not n:
        return rows
    again = F.broadcast(repeats) if n <= BROADCAST_ROWS else repeats
    again = again.withColumnRenamed("h", h)
    others = [c for c in rows.columns if c != h]
    packed = rows.join(again, h, "left_semi").select(h, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.monotonically_increasing_id().alias("_tie"))
    own = numbered(packed, [h], ["_tie"], "_k").withColumn(h, F.when(F.col("_k") > 1, F.xxhash64(h, "_k")).otherwise(F.col(h)))
    return rows.join(again, h, "left_anti").unionByName(own.select(h, "_row.*"))


def block_of(h: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(h, F.lit("block")), blocks)


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, cap: float = CAP,
    key: str = "doc_id", text: str = "text", source: str = "source",
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 0,
) -> Mix:
    """Plan a mix of all rows: sizes, sources' targets, and the blocks that every output shard draws."""
    spark = docs.sparkSession
    base = cut(
        docs.select(
            F.col(f"`{key}`").alias(key),
            F.col(f"`{source}`").alias("source"),
            source_key(F.col(f"`{source}`")).alias("skey"),
            n_words(F.col(f"`{text}`")).alias("size"),
            row_hash(key, source, text, seed).alias("h"),
        )
    )
    repeats = cut(base.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("h"))
    base = apart(base, repeats, "h")
    sizes = base.groupBy("skey", "source").agg(F.sum("size").cast("long").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = cut(
        targets(sizes, weights, budget, cap)
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
        .withColumn("passes", whole)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    )
    rows = base.join(F.broadcast(sources.select("skey", "blocks")), "skey").withColumn("block", block_of(F.col("h"), F.col("blocks"))).select(key, "skey", "size", "h", "block")

    # Each pass over a source has its own order of blocks; the rest is a prefix of the last one.
    blocks = rows.groupBy("skey", "block").agg(F.sum("size").alias("words"))
    of = F.broadcast(sources.select("skey", "rank", "blocks", "passes", "rest"))
    each = (
        blocks.join(of, "skey")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        .withColumn("at", unit("skey", "block", "pass", F.lit(seed)))
        .withColumn("bucket", F.floor(F.col("at") * F.ceil(F.col("blocks") / BUCKET)))
    )
    each = cut(each)
    up = Window.partitionBy("skey", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = each.groupBy("skey", "pass", "bucket").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    buckets = buckets.select("skey", "pass", "bucket", F.coalesce(F.sum("w").over(up), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n0"))
    within = Window.partitionBy("skey", "pass", "bucket").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        each.withColumn("w1", F.sum("words").over(within) - F.col("words"))
        .withColumn("n1", F.row_number().over(Window.partitionBy("skey", "pass", "bucket").orderBy("at", "block")) - 1)
        .join(buckets, ["skey", "pass", "bucket"])
        .withColumn("before", F.col("w0") + F.col("w1"))
        .withColumn("place", F.col("n0") + F.col("n1"))
    )
    full = (F.col("pass") < F.col("passes")) | (F.col("before") + F.col("words") <= F.col("rest"))
    part = ~full & (F.col("before") < F.col("rest"))
    own = cut(
        placed.where(full | part).select("skey", "rank", "block", "pass", part.alias("cut"), (F.col("rest") - F.col("before")).alias("room"), "place")
    )

    # Blocks come in the order of passes; a source's draws are numbered through.
    in_pass = own.groupBy("rank", "pass").agg(F.count(F.lit(1)).alias("n"))
    quotas = in_pass.toPandas()  # at most MAX_SOURCES * (cap + 1) rows
    width = int(sources.count())
    quota = np.zeros(width, np.int64)
    np.add.at(quota, quotas["rank"].to_numpy(np.int64), quotas["n"].to_numpy(np.int64))
    words = float(sources.agg(F.sum("target")).first()[0] or 0)
    shards = max(1, int(-(-words // shard_words)))
    if int(quota.sum()) >= 10**9:
        raise ValueError("a mix has at most 1e9 blocks; give a larger block_words")
    held = spark.sparkContext.broadcast(quota)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                n, first = walk(int(shard), shards, held.value, seed)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"shard": np.full(len(at), shard, np.int32), "rank": at.astype(np.int32), "first": first[at], "n": n[at]})

    slices = spark.range(shards).mapInPandas(leaves, "shard int, rank int, first long, n long")
    dealt = slices.select("shard", "rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("number"))
    through = Window.partitionBy("rank").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(in_pass.select("rank", "pass", F.coalesce(F.sum("n").over(through), F.lit(0)).alias("start")))
    draws = cut(
        own.join(starts, ["rank", "pass"])
        .withColumn("number", F.col("start") + F.col("place"))
        .join(dealt, ["rank", "number"])
        .select("skey", "block", "pass", "cut", "shard")
    )

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "h"], ascending=[False, True])
        return x.loc[fill((x["size"] * x["n"]).tolist(), float(x["room"].iloc[0])), ["skey", "h"]]

    # One block a source, of about block_words words in rows of at least one.
    last = rows.where("size > 0").join(own.where("cut").select("skey", "block", "room"), ["skey", "block"])
    taken = cut(last.groupBy("skey", "room", "h", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("skey").applyInPandas(choose, "skey string, h long"))
    return Mix(sources, rows, draws, taken, repeats, key, text, source, seed)
