import random
from collections import Counter

import pytest

import corpus_pipeline
from orrery.llm import quality, simhash

from .test_mixing import expected, words
from .test_sharding import bids, winner
from .test_simhash import alike

rng = random.Random(21)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(600)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BENCH = [(i, prose(30)) for i in range(8)]


def corpus():
    rows = []
    for i in range(160):
        rows.append((i, prose(rng.randint(60, 300))))
    for i in range(160, 200):  # near copies: two words of a long text differ
        w = rows[rng.randrange(40)][1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, "short text") for i in range(5)] + [(210, "spam " * 200), (211, None), (212, "")]
    rows += [(220 + i, f"{prose(80)} {BENCH[i][1]} {prose(80)}") for i in range(8)]
    rows += [(None, prose(100)), (5, rows[5][1]), (5, rows[5][1]), (300, prose(30_000))]
    return [(k, t, "en", rng.choice(["x", "y", None]), len(t or "")) for k, t in rows]


def survivors(rows):
    rows = [r for r in rows if r[1] and not any(rule.rejects(quality.Doc(r[1])) for rule in quality.RULES)]
    group = alike([r[1] for r in rows])
    best = {}
    for i, g in enumerate(group):
        if g not in best or (rows[i][0] is None, rows[i][0] or 0) < (rows[best[g]][0] is None, rows[best[g]][0] or 0):
            best[g] = i
    kept = [rows[i] for i in best.values()]
    return [r for r in kept if not any(t in r[1] for _, t in BENCH)]


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "benchmark_decontamination":
            want = survivors(rows)
            assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter((k, t) for k, t, *_ in want)
    got = docs.collect()
    known = {(r[0], r[1]): r for r in want}
    assert {(r["doc_id"], r["text"]) for r in got} <= set(known)
    sizes, target = expected([(k, t, s) for k, t, _, s, _ in want])
    taken = Counter()
    for r in got:
        taken[known[r["doc_id"], r["text"]][3]] += words(r["text"])
    longest = max(words(r[1]) for r in want)
    for s in sizes:
        room = longest if s == known[300, rows[-1][1]][3] else 60
        assert abs(taken[s] - target[s]) <= room
    for r in got:
        costs = bids(r["doc_id"], [1.0] * (corpus_pipeline.SHARDS + 1))
        assert (r["shard"], r["grown_shard"]) == (winner(costs[:-1]), winner(costs))
    assert max(Counter((r["doc_id"], r["text"]) for r in got).values()) <= 2
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in again) == Counter((r["doc_id"], r["shard"]) for r in got)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_anything(spark, tmp_path, stage):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "x", 0), (2, prose(50), None, None, None), (2, prose(50), None, None, None)]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as block", "2 as size", "3 as h", "4 as fp", "5 as _key")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= 8
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_stage_list():
    assert len(corpus_pipeline.STAGES) == 5 and simhash.RADIUS == 4
