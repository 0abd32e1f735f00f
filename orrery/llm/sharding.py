"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Every shard bids for every key with an exponential draw that the key, the shard and the seed alone decide; the lowest
bid wins. A shard added later can only take keys for itself, and on average takes its share by weight. Assigning needs
no shuffle. Slots (gapless positions in a shard) are dealt in two levels, so that no task ever holds a whole shard:
rows are numbered within (shard, bucket), and buckets get offsets from a table of at most shards x buckets counts.

Defined results: a null key is a key like any other, so all null keys share a shard; rows with equal keys share a shard
and get different slots; an empty table gives an empty result; extra columns stay as they are, but columns named
``shard``, ``grown_shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, free_name

BUCKETS = 1024


def bid(key: Column, shard: int, weight: float = 1.0, seed: int = 0) -> Column:
    """The exponential draw of a shard for a key; its mean is 1 / weight."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.ln(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """struct(cost, shard) of the winning shard; ties go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    bids = [F.struct(bid(key, i, w, seed).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return bids[0] if len(bids) == 1 else F.least(*bids)


def assign_shards(
    df: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, grown_weight: float = 1.0, seed: int = 0
) -> DataFrame:
    """Append ``shard`` (int) and ``grown_shard`` (int, the shard if one more of ``grown_weight`` is added)."""
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards:
        raise ValueError("weights must have one entry for each shard")
    best = free_name(df, "_best")
    kept = [c for c in df.columns if c.lower() not in ("shard", "grown_shard")]
    new = bid(F.col(f"`{key}`"), shards, grown_weight, seed)
    return (
        df.withColumn(best, rendezvous(F.col(f"`{key}`"), weights, seed))
        .select(
            *[F.col(f"`{c}`") for c in kept],
            F.col(best)["shard"].cast("int").alias("shard"),
            F.when(new < F.col(best)["cost"], F.lit(shards)).otherwise(F.col(best)["shard"]).cast("int").alias("grown_shard"),
        )
    )


def number_slots(df: DataFrame, order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Append ``slot`` (long), gapless from 0 within each ``shard``. ``order``: columns that tell rows apart; rows that
    they don't tell apart get neighbouring slots in any order. Materialises ``df`` once: give it narrow rows."""
    df = df.drop("slot")
    b, first = free_name(df, "_bucket"), free_name(df, "_first")
    keys = [F.col(f"`{c}`") for c in order]
    rows = cut(df.withColumn(b, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    ahead = Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", b)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", b, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias(first))
    )
    within = F.row_number().over(Window.partitionBy("shard", b).orderBy(*keys)) - 1
    # At most shards x buckets rows: a bound that does not grow with the data.
    return (
        rows.withColumn("slot", within)
        .join(F.broadcast(offsets), ["shard", b])
        .withColumn("slot", (F.col("slot") + F.col(first)).cast("long"))
        .drop(b, first)
    )
