"""Folds over ranges against plain loops, with a key that fills several ranges."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orrery.operators import anomaly, folds, series


def made(n=900, seed=5):
    rng = random.Random(seed)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i // 2, rng.choice([1, 2, 3, 50])) for i in range(n)]
    return rows + [("hot", 10**6 + i, 7) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_fold_and_runs(spark, parts):
    rows = made()
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(3)
    kept = folds.ranged(df, ["k"], ["t", "v"], parts).groupBy("k").agg(F.count_distinct("_range").alias("n"))
    assert parts < 7 or {r["k"]: r["n"] for r in kept.collect()}["hot"] > 3

    def step(state, row):  # not associative, so the order of rows and the handing over count
        x = (state[0] * 31 + row[1]) % 1009
        return (x,), (row[0], row[1], x) if x % 2 else None

    got = folds.fold(df, ["k"], ["t", "v"], (1,), step, "x long", "t long, v long, x long", parts)
    want, runs, by = Counter(), Counter(), defaultdict(list)
    for k, t, v in rows:
        by[k].append((t, v))
    for k, xs in by.items():
        state, run = (1,), 0
        for t, v in sorted(xs):
            state, out = step(state, (t, v))
            run = run + 1 if v > 2 else 0
            runs[k, t, v, run] += 1
            if out:
                want[(k, *out)] += 1
    assert Counter(map(tuple, got.collect())) == want
    lengths = folds.run_lengths(df, ["k"], ["t", "v"], F.col("v") > 2, parts)
    assert Counter((r["k"], r["t"], r["v"], r["run"]) for r in lengths.collect()) == runs


def test_a_hot_series_is_spread(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [("hot", start + timedelta(hours=i), 100 + rng.random() - (80 if i % 97 == 0 else 0)) for i in range(24 * 60)] + [("cold", start, None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    got = anomaly.seasonal_hits(df, "k", parts=60).collect()
    assert {(r["ts"], round(r["z"], 9)) for r in got} == {(r["ts"], round(r["z"], 9)) for r in anomaly.seasonal_hits(df, "k", parts=1).collect()}
    assert got and all(r["direction"] == "drop" and 0.5 <= r["score"] <= 0.99 for r in got if r["value"] < 50)
    late = [i for i in range(24 * 30, 24 * 60) if i % 97 == 0]
    assert {start + timedelta(hours=i) for i in late} <= {r["ts"] for r in got}


def test_empty(spark):
    none = spark.createDataFrame([], "k string, ts timestamp_ntz, value double, drop boolean")
    assert anomaly.seasonal_hits(none, "k").collect() == []
    assert series.runs(none, "k", F.col("value") > 1, ["ts"]).collect() == []
    assert series.outages(none.withColumn("hit", F.lit(True)), "k", ["ts"]).collect() == []
