import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orrery.llm import prefix_trie


def plain(rows):
    """The nodes, from whole conversations in memory."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t), role or "", text or ""))
    for c, turns in own.items():
        digest = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()
        own[c] = [(r, x) for _, r, x in sorted(turns, key=lambda x: (x[0][0], x[0][1] or 0, digest(x)))]
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, own.get(c - c % 5, [])
        whole[c] = base[:h] + turns[h:]
    members = {}
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((cs[0], len(p), members[p[:-1]][0] if p else -1, len(cs), kids[p], leaves[p], saved[p], ends(p)) for p, cs in members.items())


def run(spark, rows, local=None):
    turns = prefix_trie.encoded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as b"))
    conv = F.col("conv")
    out = prefix_trie.trie(prefix_trie.rebuilt(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8), local)
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def drawn(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        common = rng.choice([0, 2, 6])
        for t in range(rng.randrange(9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"common {t}" if t < common else rng.choice("abé")))
    return rows


ODD = [(None, 1, "user", "x"), (1000, None, None, None), (1000, 0, "user", ""), (1001, 5, "user", "a"), (1001, 5, "user", "a"), (1001, 5, "user", "b"), (1004, 1, None, "z" * 10_000)]


@pytest.mark.parametrize("local", [None, 30])
def test_against_whole_conversations(spark, local):
    rows = drawn(3) + ODD
    assert run(spark, rows, local) == plain(rows)


def test_equal_conversations_and_long_ones(spark):
    rows = [(5 * c, t, "user", f"t{t}") for c in range(30) for t in range(40)] + [(7, t, "user", f"t{t}") for t in range(300)] + [(8, 0, "user", "alone")]
    assert run(spark, rows, 1000) == plain(rows)


def test_no_turns_left_and_no_rows(spark):
    lone = next(c for c in range(6, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)  # its base is absent
    assert run(spark, [(lone, 0, "user", "x")]) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert run(spark, [(None, 0, "user", "x")]) == []


def test_a_bucket_in_a_task():
    nodes = prefix_trie.finish([9, 4, 6], [[1, 2], [1], [3]], [[10, 20], [10], [5]], 2, 3, 7)
    assert nodes[0][:7] == (4, 2, 3, 3, 2, 2, 2 * 7 + 10)
    assert sorted(n[:7] for n in nodes[1:]) == [(4, 3, 4, 2, 1, 1, 10), (6, 3, 4, 1, 0, 1, 0), (9, 4, 4, 1, 0, 1, 0)]
