"""A filter that tasks build is the one that a loop builds: it passes every key and few others."""

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import bloom


def test_built_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(bloom, "SLICE", 7)  # many slices
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    hashes = keys.select(*bloom.hashes(F.col("k")))
    own = bloom.built(hashes, 3000)
    plain = bloom.BlockedBloom(own.blocks)
    got = hashes.toPandas()
    plain.add(got["h1"].to_numpy(), got["h2"].to_numpy())
    assert (own.bits == plain.bits).all() and own.bits.any()
    asked = keys.unionByName(spark.range(3000, 23000).select(F.concat(F.lit("k"), "id").alias("k")))
    passed = [int(r["k"][1:]) for r in bloom.sifted(asked, own, "k").collect()]
    assert set(range(3000)) <= set(passed) and len(passed) < 3000 + 20000 * 0.02


def test_without_keys(spark):
    none = bloom.built(spark.range(0).select(*bloom.hashes(F.col("id"))), 0)
    assert none.blocks == 1 and not none.bits.any()
    assert not none.passes(np.array([1, -5]), np.array([3, -9])).any()
    assert bloom.sifted(spark.range(5), none, "id").collect() == []
