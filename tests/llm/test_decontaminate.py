import random
import time

import numpy as np
import pytest

from orrery.llm import decontaminate as d

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]


def prose(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


ITEMS = [prose(n) for n in (40, 25, 15, 60, 9)]


def put(item, edit=lambda w: w, around=200):
    return " ".join(prose(around) + edit(list(item)) + prose(around))


def every(n, word="Q"):
    return lambda w: [word if i % n == n - 1 else x for i, x in enumerate(w)]


@pytest.fixture(scope="module")
def cases():
    leaking = {
        1: (put(ITEMS[0]), 0),
        2: (put(ITEMS[1], every(7)), 1),
        3: (put(ITEMS[2]).upper().replace(" ", ", "), 2),
        4: (put(ITEMS[3], lambda w: w[:30] + ["Q"] + w[30:]), 3),
        5: (put(ITEMS[3], lambda w: w[20:45]), 3),
        6: (put(ITEMS[4]), 4),
        7: (" ".join(ITEMS[2]), 2),
        8: (put(ITEMS[0], lambda w: [x for i, x in enumerate(w) if i % 10 != 4]), 0),
        9: (put(ITEMS[0], around=30_000), 0),
    }
    clean = {100 + i: " ".join(prose(300)) for i in range(40)} | {200: put(ITEMS[0], lambda w: w[:6]), 201: put(ITEMS[3], every(2)), 202: "", 203: None, 204: "a b"}
    return leaking, clean


def tables(spark, cases):
    leaking, clean = cases
    docs = spark.createDataFrame([(k, t, k) for k, (t, _) in leaking.items()] + [(k, t, k) for k, t in clean.items()] + [(None, leaking[1][0], 7)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(ITEMS)] + [(90, None), (91, "too short"), (92, " ".join(ITEMS[2]))], "item_id long, text string")
    return docs, bench


@pytest.mark.parametrize("most", [d.BLOCK_HASHES, 100])
def test_leaks(spark, cases, most):
    docs, bench = tables(spark, cases)
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, bench, most=most).collect()}
    want = {(k, i) for k, (_, i) in cases[0].items()} | {(None, 0), (3, 92), (7, 92)}
    assert got == want


def test_keep_clean(spark, cases):
    docs, bench = tables(spark, cases)
    got = d.keep_clean(docs, bench)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == set(cases[1])
    assert d.keep_clean(docs, bench.limit(0)).count() == docs.count()
    assert d.keep_clean(docs.limit(0), bench).count() == 0
    assert d.find_leaks(docs, bench.limit(0)).columns == ["doc_id", "item_id", "start", "end", "n_match", "coverage"]


def test_against_brute_force():
    """Every copied stretch of 13 tokens with one substitution in every seven or fewer is found by some seed."""
    block = d.TestBlock()
    for i, w in enumerate(ITEMS):
        block.add(i, w)
    block.close()
    for _ in range(200):
        i = rng.randrange(len(ITEMS) - 1)
        own = list(ITEMS[i])
        for at in range(rng.randrange(7), len(own), 7):
            own[at] = "Q"
        text = prose(50) + own + prose(50)
        ids = np.array([block.vocabulary.get(w, 0) for w in text], np.int64)
        best = max(sum(a == b for a, b in zip(text[s : s + len(own)], ITEMS[i], strict=False)) for s in range(len(text) - len(own) + 1))
        found = [x for x in d.leaks(block, ids) if x.item == i]
        assert found and found[0].matched >= best - 3


def test_text_that_repeats_itself_takes_no_product(spark):
    """A sentence of 20 words, 500 times, and 200 items that hold it: each item leaks, and once."""
    sentence, items = prose(20), [prose(15) for _ in range(200)]
    block = d.TestBlock()
    for i, w in enumerate(items):
        block.add(i, w[:8] + sentence + w[8:])
    block.close()
    ids = np.array([block.vocabulary.get(w, 0) for w in sentence * 500], np.int64)
    began, found = time.process_time(), list(d.leaks(block, ids))
    assert [x.item for x in found] == list(range(200)) and min(x.matched for x in found) >= 20
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", ["日本語の文章を書く練習問題です", "ข้อความภาษาไทยสำหรับทดสอบ"])
def test_scripts_without_blanks(text):
    block = d.TestBlock()
    block.add(1, d.tokens(text))
    block.close()
    ids = np.array([block.vocabulary.get(w, 0) for w in d.tokens(f"前置き{text}。終わり")], np.int64)
    assert [block.items[x.item][0] for x in d.leaks(block, ids)] == [1]


def test_column_names_differ_in_case(spark, cases):
    docs, bench = tables(spark, cases)
    own = docs.withColumnRenamed("text", "TEXT").selectExpr("TEXT", "doc_id", "'clean' as last")
    assert {r["doc_id"] for r in d.keep_clean(own, bench).collect()} == set(cases[1])
