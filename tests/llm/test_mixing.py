import random
import re
from collections import Counter

import numpy as np
import pytest

from orrery.llm import mixing

KIND = "doc_id long, text string, source string"


def words(t):
    return len(re.findall("[^ \t\n\v\f\r]+", t or ""))


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    pick = lambda: rng.choices(["a", "b", "é", "\U00010000", "￮", None], [40, 5, 10, 3, 10, 8])[0]
    rows = [(i, "w " * rng.choice([1, 3, 40, 200]), pick()) for i in range(n)]
    rows += [(None, "null key", "a"), (5000, None, "a"), (5001, "", "b"), (5002, " \n", "empty"), (5003, None, "empty")]
    return rows + rows[10:14] + [(6000, "long " * 20_000, "a")]


def expected(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in out]
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return sizes, out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block,shard", [(mixing.BLOCK_WORDS, mixing.SHARD_WORDS), (300, 2000), (50, 900)])
def test_counts(spark, monkeypatch, block, shard):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    rows = corpus()
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as skey", "2 as size")
    m = mixing.mix(docs, block_words=block, shard_words=shard)
    got = m.counts().collect()
    sizes, target = expected(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((k, words(t)) for k, t, _ in rows)
    of = {(k, words(t)): s for k, t, s in rows}
    taken = Counter()
    for r in got:
        s = of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] in {0, r["size"], 2 * r["size"]}
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]) or s == "a", s
    assert abs(taken["a"] - target["a"]) <= 10_001  # the long document is taken whole or not
    again = mixing.mix(docs.repartition(3), block_words=block, shard_words=shard).counts().collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))

    out = m.rows_of(docs)
    assert out.columns == [*docs.columns, "shard"]
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    drawn = Counter()
    for r in got:
        if r["size"]:
            drawn[next(x for x in rows if x[0] == r["doc_id"] and words(x[1]) == r["size"])] += r["taken"] // r["size"]
    assert +drawn == Counter({x: n for x, n in times.items() if words(x[1])})
    draws = m.draws.collect()
    assert len({(d["skey"], d["block"], d["pass"]) for d in draws}) == len(draws)


def test_tree_is_exact():
    quotas = np.array([7, 0, 40, 3, 1000])
    for shards in (1, 2, 13, 64):
        parts = [mixing.walk(i, shards, quotas, 4) for i in range(shards)]
        assert (sum(n for n, _ in parts) == quotas).all()
        for s in range(len(quotas)):
            ranges = sorted((f[s], f[s] + n[s]) for n, f in parts if n[s])
            assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        totals = [n.sum() for n, _ in parts]
        assert max(totals) - min(totals) <= np.ceil(np.log2(shards)) + 1


def test_fill():
    assert fill_sum([5, 3, 2, 2], 9) == 8 or fill_sum([5, 3, 2, 2], 9) == 10
    assert fill_sum([10], 6) == 10 and fill_sum([10], 4) == 0 and fill_sum([], 4) == 0


def fill_sum(sizes, room):
    return sum(s for s, t in zip(sizes, mixing.fill(sizes, room), strict=True) if t)


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    m = mixing.mix(none)
    assert m.counts().collect() == [] and m.rows_of(none).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "x")], KIND)
    assert {r["taken"] for r in mixing.mix(blank).counts().collect()} == {0}


@pytest.mark.parametrize("few", [mixing.BROADCAST_ROWS, 0])
def test_repeated_rows_meet_the_target(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", few)
    rows = [(i, f"{i} " * 10, "x") for i in range(50)] + [(1007, "same " * 10, "y")] * 100 + [(1008, "other " * 10, "y")] * 3
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as _n", "2 as `_k`").repartition(5)
    m = mixing.mix(docs, block_words=100, shard_words=400)
    sizes, target = expected(rows)
    got = m.counts().collect()
    assert len(got) == len(rows)
    for s, keys in (("x", range(50)), ("y", (1007, 1008))):
        taken = sum(r["taken"] for r in got if r["doc_id"] in keys)
        assert abs(taken - target[s]) <= 10, (s, taken, target[s])
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    out = Counter(r["doc_id"] for r in m.rows_of(docs).collect())
    assert out[1007] + out[1008] == sum(r["taken"] for r in got if r["doc_id"] in (1007, 1008)) // 10
    again = mixing.mix(docs.repartition(2), block_words=100, shard_words=400).counts().collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
