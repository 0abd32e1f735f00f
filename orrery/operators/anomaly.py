"""Anomalies: a seasonal detector of series, and a space-time scan of events."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.geo import haversine_km
from ..functions.stats import excess_llr
from .folds import fold
from .numbering import numbered

# Learning rates, samples before detection, threshold, share learnt from anomalies; cylinders of the scan.
LEVEL, SCALE, LEAST, THRESHOLD, DAMPED = 0.06, 0.03, 6, 3.5, 0.15
RADII_KM, WINDOWS_H = (8, 15, 25, 40), (24, 72, 168)


def season(ts: Column) -> Column:
    """Hour of the day, and 24 more on weekends."""
    return F.hour(ts) + F.when(F.dayofweek(ts).isin(1, 7), 24).otherwise(0)


def _learn(state: tuple, row: tuple, threshold: float) -> tuple[tuple, tuple | None]:
    """One sample (ts, value) into (n, level, scale) of its key and season; what it emits if it is anomalous."""
    (n, level, scale), (ts, v) = state, row
    if n == 0:
        return (1, v, max(1e-6, abs(v) * 0.12)), None
    z = (v - level) / max(scale, abs(level) * 0.03, 1e-6)
    hit = n >= LEAST and abs(z) >= threshold
    rate = DAMPED if hit else 1.0
    learnt = (n + 1, level + rate * LEVEL * (v - level), scale + rate * SCALE * (abs(v - level) - scale))
    return learnt, (ts, v, level, z) if hit else None


def seasonal_hits(samples: DataFrame, key: str, threshold: float = THRESHOLD, parts: int | None = None) -> DataFrame:
    """key, ts, value, expected, z, direction, score of the anomalous samples (key, ts, value). Each (key, season) is
    folded on its own: an exponential mean of level and deviation, learnt more slowly from anomalies. Samples are taken by
    ts, then value; nulls are left out. A key of any length is spread over ranges (``folds.fold``)."""
    kind = dict(samples.dtypes)["ts"]
    rows = samples.where("value is not null").select(key, season(F.col("ts")).alias("_s"), "ts", F.col("value").cast("double").alias("value"))
    out = f"ts {kind}, value double, expected double, z double"
    hits = fold(rows, [key, "_s"], ["ts", "value"], (0, 0.0, 0.0), partial(_learn, threshold=threshold), "n long, level double, scale double", out, parts).drop("_s")
    over = (F.abs(F.col("z")) - threshold) / threshold
    return hits.withColumns(
        {"direction": F.when(F.col("z") < 0, "drop").otherwise("spike"), "score": F.least(F.lit(0.99), 0.5 + 0.5 * (1 - F.exp(-over)))}
    )


def cylinders(events: DataFrame, now_ts: Column, baseline_h: int = 720) -> DataFrame:
    """centre, radius_km, hours, observed, expected, llr (and what they come from) of every cylinder around a settlement. ``events``: ts, lat, lon,
    weight. Expected is the settlement's share of the time before the longest window, of the total now; the half counts
    keep an empty baseline from being certain. Cylinders are few: one row a cylinder leaves each task."""
    hours = F.timestamp_diff("MICROSECOND", F.col("ts"), now_ts) / 3.6e9
    rows = events.where("lat is not null").withColumn("_h", hours).where((F.col("_h") >= 0) & (F.col("_h") < baseline_h))
    at = F.array(*[F.struct(F.lit(p[0]).alias("centre"), haversine_km(F.col("lat"), F.col("lon"), p[1], p[2]).alias("km")) for p in dims.PLACES])
    longest = max(WINDOWS_H)
    totals = rows.agg(
        F.sum(F.when(F.col("_h") >= longest, F.col("weight")).otherwise(0.0)).alias("before"),
        *[F.sum(F.when(F.col("_h") < w, F.col("weight")).otherwise(0.0)).alias(f"t{w}") for w in WINDOWS_H],
    )
    near = rows.select("_h", "weight", F.inline(at)).where(F.col("km") <= max(RADII_KM))
    counts = near.groupBy("centre").agg(
        *[F.sum(F.when((F.col("km") <= r) & (F.col("_h") >= longest), F.col("weight")).otherwise(0.0)).alias(f"b{r}") for r in RADII_KM],
        *[F.sum(F.when((F.col("km") <= r) & (F.col("_h") < w), F.col("weight")).otherwise(0.0)).alias(f"o{r}_{w}") for r in RADII_KM for w in WINDOWS_H],
    )
    each = F.array(*[
        F.struct(F.lit(r).alias("radius_km"), F.lit(w).alias("hours"), F.col(f"o{r}_{w}").alias("observed"), F.col(f"t{w}").alias("total"), F.col(f"b{r}").alias("b"))
        for r in RADII_KM for w in WINDOWS_H
    ])
    out = counts.crossJoin(F.broadcast(totals)).select("centre", "before", F.inline(each))  # totals: one row
    expected = (F.col("b") + 0.5) / (F.col("before") + 1.0) * F.col("total")
    return out.withColumn("expected", expected).select("centre", "radius_km", "hours", "observed", "expected", "total", "before", "b", excess_llr(F.col("observed"), F.col("expected"), F.col("total")).alias("llr"))


def gated_llr(observed: np.ndarray, expected: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``excess_llr`` of arrays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rest, rest_expected = total - observed, total - expected
        outside = np.where((rest > 0) & (rest_expected > 0), rest * np.log(rest / rest_expected), 0.0)
        x = observed * np.log(observed / expected) + outside
    return np.where((observed >= 3) & (observed > expected) & (expected > 0), x, 0.0)


def apart(found: list[dict], tops: list[float], most: int, alpha: float = 0.05, excess: float = 3.0) -> list[dict]:
    """The strongest cylinders that do not describe one concentration twice: of ``found`` (strongest first), those further
    from all before than the larger radius, with p_value (rank among ``tops``) and whether it is significant; one that is
    not, and has no threefold excess, is left out."""
    out: list[dict] = []
    at = {p[0]: (math.radians(p[1]), math.radians(p[2])) for p in dims.PLACES}

    def km(x: str, y: str) -> float:
        (a, b), (c, d) = at[x], at[y]
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    for c in found:
        if len(out) >= most:
            break
        if any(km(o["centre"], c["centre"]) <= max(o["radius_km"], c["radius_km"]) for o in out):
            continue
        p = (sum(t >= c["llr"] for t in tops) + 1) / (len(tops) + 1)
        if p <= alpha or c["observed"] / max(1e-9, c["expected"]) >= excess:
            out.append({**c, "p_value": p, "significant": p <= alpha})
    return out


def scan(found: DataFrame, replicas: int = 99, seed: int = 7, most: int = 5, alpha: float = 0.05) -> DataFrame:
    """centre, radius_km, hours, observed, expected, llr, p_value, significant: the strongest cylinders of ``found`` (see
    ``cylinders``) that are ``apart``. p_value ranks one among the largest values of replicas, each of which draws every
    cylinder's share from its posterior and its count from that share. The cylinders are settlements x radii x windows, a
    table of fixed size that is broadcast, and read on the driver to select from."""
    tested = found.where("total >= 4")
    grid = tested.orderBy("centre", "radius_km", "hours").toPandas()
    held = found.sparkSession.sparkContext.broadcast(grid)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = held.value
        b, before, total = (g[c].to_numpy(float) for c in ("b", "before", "total"))
        for x in batches:
            out = []
            for i in x["id"]:
                rng = np.random.default_rng([seed, int(i)])
                p = rng.beta(b + 0.5, np.maximum(before - b, 0.0) + 0.5)
                n = np.floor(total + 0.5).astype(int)
                out.append(gated_llr(rng.binomial(n, p).astype(float), g["expected"].to_numpy(float), total).max(initial=0.0))
            yield pd.DataFrame({"top": out})

    tops = [r["top"] for r in found.sparkSession.range(replicas).mapInPandas(draw, "top double").collect()]
    columns = ["centre", "radius_km", "hours", "observed", "expected", "llr"]
    strongest = grid[grid["llr"] > 0].sort_values(["llr", "centre", "radius_km", "hours"], ascending=[False, True, True, True])
    chosen = apart(strongest[columns].to_dict("records"), tops, most, alpha)
    kind = "centre string, radius_km int, hours int, observed double, expected double, llr double, p_value double, significant boolean"
    rows = [(c["centre"], int(c["radius_km"]), int(c["hours"]), *(float(c[k]) for k in ("observed", "expected", "llr", "p_value")), bool(c["significant"])) for c in chosen]
    return found.sparkSession.createDataFrame(rows, kind)


def half_spaces(dims_n: int, trees: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and split of every node, [tree, node] in heap order: splits lie in the middle half of a node's range."""
    rng, nodes = np.random.default_rng(seed), 2 ** (depth + 1) - 1
    dim, share = rng.integers(dims_n, size=(trees, nodes)), 0.25 + 0.5 * rng.random((trees, nodes))
    low, high = np.zeros((trees, nodes, dims_n)), np.ones((trees, nodes, dims_n))
    split, every = np.empty((trees, nodes)), np.arange(trees)
    for n in range(nodes):
        d = dim[:, n]
        split[:, n] = low[every, n, d] + (high[every, n, d] - low[every, n, d]) * share[:, n]
        if 2 * n + 2 < nodes:
            for child, edge in ((2 * n + 1, high), (2 * n + 2, low)):
                low[:, child], high[:, child] = low[:, n], high[:, n]
                edge[every, child, d] = split[:, n]
    return dim, split


def paths(x: np.ndarray, dim: np.ndarray, split: np.ndarray, depth: int) -> np.ndarray:
    """The nodes that each row passes in each tree, [row, tree, level]."""
    every = np.arange(len(dim))
    at = np.zeros((len(x), len(dim)), int)
    out = [at]
    for _ in range(depth):
        at = 2 * at + 1 + (x[np.arange(len(x))[:, None], dim[every, at]] >= split[every, at])
        out.append(at)
    return np.stack(out, axis=2)


def half_space_scores(rows: DataFrame, key: str, order: str, features: list[str], trees: int = 25, depth: int = 8, window: int = 250, seed: int = 7) -> DataFrame:
    """key, order, score of half-space trees: 1 where the window before had no mass along a row's paths, less where it
    had much. Features lie in [0, 1]; a null counts as 0. Each key's rows, in order (ties: by their features), are cut in
    windows of so many rows; a window is scored against the one before it, and the first has null scores. The rows of a
    key are numbered by a range sort, so no task needs a whole key; a task holds two windows at a time."""
    dim, split = half_spaces(len(features), trees, depth, seed)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)]
    plain = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), *cols)
    names = [f"f{i}" for i in range(len(features))]
    placed = numbered(plain, ["k"], ["o", *names]).withColumn("w", F.floor((F.col("n") - 1) / window)).drop("n")
    both = placed.withColumn("at", F.explode(F.array(F.struct(F.col("w"), F.lit(True).alias("asked")), F.struct((F.col("w") + 1).alias("w"), F.lit(False).alias("asked")))))
    both = both.select("k", "o", *names, "at.w", "at.asked")
    most = window * (2 ** (depth + 1) - 1)

    def score(g: pd.DataFrame) -> pd.DataFrame:
        asked = g[g["asked"]]
        known = paths(g.loc[~g["asked"], names].to_numpy(float), dim, split, depth)
        out = asked[["k", "o"]].copy()
        out["score"] = np.nan
        if len(known) and len(asked):
            mass = np.zeros(dim.shape)
            for t in range(trees):
                mass[t] = np.bincount(known[:, t].ravel(), minlength=dim.shape[1])
            weight = 2.0 ** np.arange(depth + 1)
            passed = paths(asked[names].to_numpy(float), dim, split, depth)
            total = (mass[np.arange(trees)[None, :, None], passed] * weight).sum(axis=(1, 2))
            out["score"] = np.clip(1 - total / (trees * most), 0, 1)
        return out

    kinds = dict(plain.dtypes)
    scored = both.groupBy("k", "w").applyInPandas(score, f"k {kinds['k']}, o {kinds['o']}, score double")
    return scored.select(F.col("k").alias(key), F.col("o").alias(order), F.nanvl("score", F.lit(None).cast("double")).alias("score"))
