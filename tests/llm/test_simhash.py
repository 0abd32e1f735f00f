import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from orrery.llm import bktree, simhash

KIND = "doc_id long, text string"


def by_bit(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t\n\v\f\r]+", words) if w]
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hs) > len(hs) / 2)


def grouped(ids, fps, radius=4):
    """Brute force: all pairs, then a flood."""
    left, out = set(range(len(ids))), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= radius}
            left -= near
            todo += near
        own = [ids[i] for i in group if ids[i] is not None]
        for i in group:
            out[i] = min(own) if own else None
    return [out[i] for i in range(len(ids))]


TEXTS = [None, "", " \n\t", "one", "One TWO three", "É a b c d", "a b c d e f g a b c d", "x " * 3000 + "y z"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == by_bit(text)


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a shingle of four"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a shingle of four", 42)


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(120)) for _ in range(n // 5)]
    for i in range(len(rows), n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((i if i % 37 else None, " ".join(words)))
    return rows + rows[20:25]


@pytest.mark.parametrize("part", [4096, 7])
@pytest.mark.parametrize("most", [64 << 20, 0], ids=["broadcast", "tasks"])
def test_near_duplicates(spark, part, most, monkeypatch):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", most)
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame(rows, KIND).withColumnRenamed("text", "TEXT").selectExpr("*", "1 as fp"), text="TEXT").collect()
    fps = [by_bit(t) for _, t in rows]
    want = Counter(zip([k for k, _ in rows], [f"{f:016x}" for f in fps], grouped([k for k, _ in rows], fps), strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t\n\v\f\r]+", words) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(texts, least=0.8):
    """Brute force: the number of each text's group; all pairs of different sets, then a flood."""
    sets = [shingles(t) for t in texts]
    kinds = {}
    of = [kinds.setdefault(frozenset(x), len(kinds)) for x in sets]
    known = list(kinds)
    near = lambda a, b: len(a & b) >= least * max(1, len(a | b))
    group, left = {}, set(range(len(known)))
    while left:
        todo = [first := left.pop()]
        while todo:
            i = todo.pop()
            group[i] = first
            found = {j for j in left if near(known[i], known[j])}
            left -= found
            todo += found
    return [group[i] for i in of]


def near_copies(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    rows = list(enumerate(TEXTS))
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([60, 400, 2000]))] for _ in range(15)]
    for i in range(len(rows), 120):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, len(words) // 200, len(words) // 150, len(words) // 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i if i % 37 else None, " ".join(words)))
    return rows + rows[20:25]


@pytest.mark.parametrize(("part", "most"), [(4096, 64 << 20), (4096, 0), (5, 64 << 20), (5, 0)])
def test_keep_one(spark, part, most, monkeypatch):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", most)
    rows = near_copies()
    docs = spark.createDataFrame([(k, t, "s", i) for i, (k, t) in enumerate(rows)], KIND + ", source string, _k int")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = [r["_k"] for r in got.collect()]
    groups = alike([t for _, t in rows])
    assert Counter(groups[i] for i in kept) == Counter(set(groups)) and len(kept) < len(rows) // 2
    for i in kept:
        own = [rows[j][0] for j in range(len(rows)) if groups[j] == groups[i] and rows[j][0] is not None]
        assert rows[i][0] == (min(own) if own else None)


@pytest.mark.parametrize("similarity", [0.85, 0.9, 0.97])
def test_near_copies_meet(similarity):
    """Held-out recall of the steps before the count of minima: a shared band, and fingerprints within the radius."""
    rng = random.Random(9)
    met = 0
    for _ in range(200):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
        other = list(words)
        while len((x := shingles(" ".join(words))) & (y := shingles(" ".join(other)))) > similarity * len(x | y):
            last = list(other)
            other[rng.randrange(len(other))] = "changed"
        a, b = (simhash.hashes(" ".join(w), 5) for w in (words, last))
        m, n = simhash.minima(np.unique(a)), simhash.minima(np.unique(b))
        bands = (m == n)[: simhash.BANDS * simhash.ROWS].reshape(simhash.BANDS, -1).all(axis=1).any()
        met += bands and (simhash.majority(a) ^ simhash.majority(b)).bit_count() <= simhash.WIDE
    assert met >= 197


def test_repeats_of_a_line_part_no_copies(spark):
    """Texts alike but for how often a line occurs: their sets are, and so they meet."""
    rng = random.Random(12)
    pick = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows = []
    for i in range(20):
        words, line, times = pick(600), pick(8), rng.choice([15, 25])
        rows += [(2 * i, " ".join(words[:300] + line + words[300:])), (2 * i + 1, " ".join(words[:300] + line * times + words[300:]))]
    docs = spark.createDataFrame(rows, KIND)
    fp = {r["doc_id"]: r["fp"] for r in simhash.sketches(docs, ["doc_id"], "text").collect()}
    assert max(((fp[2 * i] ^ fp[2 * i + 1]) % 2**64).bit_count() for i in range(20)) <= 6
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [2 * i for i in range(20)]


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []


def balls(seed=1, centres=40):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    return np.unique(np.concatenate([centre, *[centre ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(b // 3)) for b in range(40)]]))


@pytest.mark.parametrize("big", [1, 100, 10**9])
def test_trees_find_all(big, monkeypatch):
    monkeypatch.setattr(bktree, "BIG", big)
    fp = balls()
    tree = np.sort(np.random.default_rng(2).integers(0, 3, len(fp)))
    trees = bktree.Trees.build(fp, fp.view(np.int64), tree)
    found = {(int(q), int(m)) for qs, ms in trees.search(fp, tree, 4) for q, m in zip(qs, ms, strict=True)}
    near = {(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero((tree == tree[i]) & (np.bitwise_count(fp ^ fp[i]) <= 4))}
    assert found == near
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    place = lambda xs: np.array([at[int(x)] for x in xs])
    a, b = trees.linked(fp, fp.view(np.int64), tree, 4)
    want = bktree.merge(np.arange(len(fp)), *map(np.array, zip(*near, strict=True)))
    assert len(a) == len(fp) - len(set(want)) and (bktree.merge(np.arange(len(fp)), place(a), place(b)) == want).all()


def test_children_are_keyed_by_distance():
    fp = balls()
    trees = bktree.Trees.build(fp, fp.view(np.int64), np.zeros(len(fp), np.int64))
    down = trees.parent >= 0
    assert (~down).sum() == 1 and (trees.edge[down] == np.bitwise_count(fp[down] ^ fp[trees.parent[down]])).all()
    assert len({(p, e) for p, e in zip(trees.parent[down], trees.edge[down], strict=True)}) == down.sum()
    for i in np.flatnonzero(down):  # every member lies below each forebear along the edge of its distance
        at = i
        while trees.parent[at] >= 0:
            assert np.bitwise_count(fp[i] ^ fp[trees.parent[at]]) == trees.edge[at]
            at = trees.parent[at]


def test_edges_are_followed_on_the_documents(spark):
    """The trees of the registered query's own table are real ones: most members hang below a root, edges are followed
    to them, and most are passed over."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fp = np.unique(np.array([r["fp"] for r in simhash.fingerprints(docs).collect()], np.int64)).view(np.uint64)
    masks = simhash.choices(len(fp), simhash.RADIUS)
    c = np.repeat(np.arange(len(masks)), len(fp))
    v = np.concatenate([fp & np.uint64(m) for m in masks])
    order = np.lexsort((v, c))
    c, v, members = c[order], v[order], np.tile(fp, len(masks))[order]
    tree = np.cumsum(np.concatenate([[False], (c[1:] != c[:-1]) | (v[1:] != v[:-1])]))
    trees = bktree.Trees.build(members, members.view(np.int64), tree)
    assert (trees.parent >= 0).sum() > 0.9 * len(members) and trees.size.max() >= 50
    a, _ = trees.linked(members, members.view(np.int64), tree, simhash.RADIUS)
    assert len(a) > 0
    asked = trees.size[tree].sum()
    assert len(members) < trees.followed < asked


@pytest.mark.parametrize("n", [10, 10**7, 10**9, 10**12])
def test_choices_lose_nothing(n):
    rng = random.Random(n)
    masks = simhash.choices(n, 4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)
