import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash

from orrery.llm import sharding
from orrery.llm.queries import op9_sharding


def chain(*parts):
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(p, h)
    return h


def bids(key, weights, seed=0):
    """The bids, from the published definition of XXH64 alone."""
    out = []
    for i, w in enumerate(weights):
        h = chain(None if key is None else struct.pack("<q", key), struct.pack("<i", i), struct.pack("<i", seed))
        out.append(-math.log(((h >> 11) + 0.5) * 2.0**-53) / w)
    return out


def winner(costs):
    return min(range(len(costs)), key=lambda i: (costs[i], i))


ROWS = [(i, f"text {i}") for i in range(3000)] + [(None, "a"), (None, None), (5, "text 5"), (5, "text 5"), (5, "other"), (-1, ""), (2**62, "x" * 100_000)]


def test_against_brute_force(spark):
    weights = [1.0, 1.0, 2.0, 0.5, 3.0]
    docs = spark.createDataFrame(ROWS, "id long, text string").selectExpr("*", "'x' as shard", "1 as _best", "2 as SLOT")
    out = sharding.assign_shards(docs, "id", 5, weights)
    got = out.collect()
    assert out.columns == ["id", "text", "_best", "SLOT", "shard", "grown_shard"]
    for r in got:
        costs = bids(r["id"], [*weights, 1.0])
        assert (r["shard"], r["grown_shard"]) == (winner(costs[:-1]), winner(costs))
    share = Counter(r["shard"] for r in got)
    assert all(abs(share[i] - len(ROWS) * w / 7.5) < 6 * math.sqrt(len(ROWS) * w / 7.5) for i, w in enumerate(weights))


def test_growing_moves_rows_to_the_new_shard_only(spark):
    docs = spark.createDataFrame(ROWS, "id long, text string")
    before = {r["id"]: r for r in sharding.assign_shards(docs, "id", 7).collect()}
    after = {r["id"]: r["shard"] for r in sharding.assign_shards(docs, "id", 8).collect()}
    assert all(after[k] == r["grown_shard"] and after[k] in (r["shard"], 7) for k, r in before.items())


def test_slots_are_gapless(spark):
    docs = sharding.assign_shards(spark.createDataFrame(ROWS, "id long, text string"), "id", 4).selectExpr("*", "9 as _bucket")
    got = sharding.number_slots(docs, ["id", "text"], buckets=8).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "7 as size", "8 as slot").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_sharding(spark, str(tmp_path)).collect()
    sizes = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes


def test_edges(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert sharding.number_slots(sharding.assign_shards(none, "id", 3), ["id"]).collect() == []
    assert {r["shard"] for r in sharding.assign_shards(spark.range(9), "id", 1).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.assign_shards(none, "id", 3, [1.0, 2.0])
    with pytest.raises(ValueError):
        sharding.assign_shards(none, "id", 2, [1.0, 0.0])
