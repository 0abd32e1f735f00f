import random

import numpy as np
import pytest

from orrery.llm import ngram_join as nj


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """Every pair of rows, compared."""
    sets, up, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    of = {}
    for i, (k, _) in enumerate(rows):
        of.setdefault(top(i), []).append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in of.items()}
    return sorted([(k, len(sets[i]), least[top(i)], links[i]) for i, (k, _) in enumerate(rows)], key=str)


def drawn(seed, groups=25, copies=6):
    """Texts, and copies with a few words changed, dropped or put in."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage, rows = [rng.choice(words) for _ in range(30)], []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 6, 9, 14, 30, 80, 300]))]
        if rng.random() < 0.4:
            at = rng.randrange(len(base) + 1)
            base[at:at] = passage
        for _ in range(rng.randrange(1, copies + 1)):
            text = list(base)
            for _ in range(rng.randrange(0, 2 + len(text) // 40)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            rows.append((rng.randrange(10**6), " ".join(text)))
    return rows


SCHEMA = "doc_id long, text string"
ODD = [(None, None), (None, "A b c"), (1, ""), (2, " \n"), (3, "a B c"), (3, "a B c"), (4, "a b"), (5, "x " * 3000), (6, "x x x x x"), (7, "é è"), (8, "É è"), (None, "solo one")]


def run(spark, rows):
    return sorted(map(tuple, nj.join_classes(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as sig", "3 as h")).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_pair(spark, seed):
    rows = drawn(seed) + ODD
    assert run(spark, rows) == plain(rows)


def test_large_buckets_and_groups_of_many_parts(spark, monkeypatch):
    """Buckets beyond what is listed, groups beyond a task, and copies of a hot set."""
    for name, value in {"BUCKET": 2, "TASK": 3, "GATHERED": 500, "SORTED": 70}.items():
        monkeypatch.setattr(nj, name, value)
    rng = random.Random(7)
    base = [f"v{i}" for i in range(120)]
    rows = drawn(5, groups=12, copies=9) + [(2000 + i, " ".join(base)) for i in range(40)]
    for i in range(40):  # a chain of changes: neighbours are linked, ends are not
        base[rng.randrange(120)] = f"n{i}"
        rows.append((3000 + i, " ".join(base)))
    assert run(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert run(spark, [(1, None)]) == [(1, 0, 1, 0)]
    assert nj.join_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_similar_sets_share_a_signature():
    """At the edge of the similarity and above it, for small and large sets, whatever the differences."""
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for _ in range(4000):
        n = int(rng.choice([2, 4, 5, 7, 9, 10, 16, 27, 45, 46, 100, 331, 900]))
        a = np.unique(draw(n))
        gone = int(rng.integers(0, n // 5 + 1))
        new = int(rng.integers(0, max(1, (100 * (n - gone) - 80 * n) // 80 + 1)))
        if rng.random() < 0.3:  # differences that lie close together
            a = np.sort(a)
            b = np.unique(np.concatenate([a[gone:], draw(new) >> np.uint64(8)]))
        else:
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], draw(new)]))
        assert nj.similar(a, b, 80)
        assert nj.may_be_similar(nj.sketch(a), nj.sketch(b), len(a), len(b), 80)
        if len(a) != len(b) or (a != b).any():
            assert np.intersect1d(nj.signatures(a), nj.signatures(b)).size


def test_unlike_sets_share_hardly_any():
    """Texts that share a passage of a tenth of their shingles seldom meet."""
    rng = np.random.default_rng(4)
    passage, met = rng.integers(0, 1 << 64, 33, dtype=np.uint64), 0
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 64, 300, dtype=np.uint64)])) for _ in range(60)]
    signed = [nj.signatures(s) for s in sets]
    assert max(map(len, signed)) < 333
    for i in range(60):
        met += sum(np.intersect1d(signed[i], signed[j]).size > 0 for j in range(i))
    assert met < 0.03 * 60 * 59 / 2


def test_large_buckets_give_no_pairs():
    """Tasks of one group of near copies, all in many common buckets: what they give is bounded by their rows, and joins all."""
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 64, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(200, 9, replace=False)), rng.integers(0, 1 << 64, 9, dtype=np.uint64)])) for _ in range(60)]
    obj = lambda xs: np.array([*xs, None], object)[:-1]
    x = {
        "v": np.full(60, 5), "i": np.zeros(60, int), "j": np.zeros(60, int), "p": np.zeros(60, int), "node": np.arange(60) * 3, "root": np.arange(60) * 3,
        "n": np.array([len(u) for u in sets]), "bits": obj(nj.sketch(u) for u in sets), "set": obj(u.tobytes() for u in sets), "sigs": obj(np.array([5, 8]) for _ in sets),
    }
    assert [len(a) for a in nj.doubtful(x, 80)] == [60, 60]
    a, b = nj.joining(x, 80)
    assert len(a) == len(b) == 59 and len({*a.tolist(), *b.tolist()}) == 60
    x["sigs"] = obj(np.array([4, 5, 8]) for _ in sets)  # all pairs are those of a smaller signature
    assert [len(a) for a in (*nj.doubtful(x, 80), *nj.joining(x, 80))] == [0, 0, 0, 0]
    x["sigs"][:2] = [np.array([3, 5]), np.array([2, 5])]  # but these two have none in common
    assert len(nj.doubtful(x, 80)[0]) == 60 and len(nj.joining(x, 80)[0]) == 59


def test_sets_and_signatures_of_many():
    """Hashes of shingles tell them apart as their words do, in their order; sets that are signed together have the signatures they have alone."""
    rng = random.Random(4)
    texts = [None, "", " \t", "a", "A", "a b", "b a", "a b c d", "a b c d e", "e d c b a", "a a a a a a a", "é x y", "a\x0bb"] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    seen, words = {}, lambda t: "".join(c.lower() if c < "\x80" else c for c in t or "").replace("\x0b", " ").replace("\t", " ").split(" ")
    for t in texts:
        w = [x for x in words(t) if x]
        whole = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        u = nj.shingle_set(t, 5)
        assert len(u) == len(whole) and (u[1:] > u[:-1]).all()
        assert seen.setdefault(u.tobytes(), whole) == whole
    assert len(set(map(frozenset, seen.values()))) == len(seen)
    draw = np.random.default_rng(6)
    sets = [np.unique(draw.integers(0, 1 << 64, n, np.uint64)) for n in [0, 1, 3, 7, 50, 51, 52, 400, 401, 5000, 400, 1]]
    for u, s in zip(sets, nj.signatures_of(sets), strict=True):
        assert sorted(s) == sorted(nj.signatures(u))
        assert len(u) < 7 or len(s) > 0.5 * len(u)
