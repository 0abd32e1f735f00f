import random
import re

import numpy as np
import pytest

from orrery.llm import quality as q

KIND = "doc_id long, text string"


def words(t):
    return re.findall("[^ \t\n\v\f\r]+", t or "")


def repeat_words(ws, k=8):
    at = {}
    for i in range(len(ws) - k + 1):
        at.setdefault(tuple(ws[i : i + k]), []).append(i)
    return len({i + j for found in at.values() if len(found) > 1 for i in found for j in range(k)})


def dup_lines(t):
    seen, n = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            n += line in seen
            seen.add(line)
    return n


def texts():
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", "a", "and", "größe", "xyz", "日本"]) + str(rng.randint(0, 99)) for _ in range(n))
    some = prose(12)
    return [
        None, "", " \n\t\x0b", "one two", prose(19), prose(20), prose(300), "\n".join([some] * 5), f"{some}\n{prose(80)}\n{some}\n \n", "a b " * 30,
        " ".join(w + "###" for w in prose(40).split()), prose(60).upper() + "!!", "x\x1cy\x85z " * 30, "w" * 300_000, prose(20_000), "a " * 7 + "a", "a " * 8 + "a",
    ]


def test_measures(spark):
    rows = list(enumerate(texts())) + [(None, "null id " * 9), (3, "one two"), (3, "one two")]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as n_words", "'x' as first_failed", "2 as _text")
    got = q.judge(docs).collect()
    assert len(got) == len(rows)
    at = {(r["doc_id"]): r for r in got}
    for i, t in rows:
        r, ws = at[i], words(t)
        assert r["n_words"] == len(ws) and r["word_chars"] == sum(map(len, ws))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["n_dup_lines"] == dup_lines(t) and r["n_repeat_words"] == repeat_words(ws)
        assert r["_text"] == 2


@pytest.mark.parametrize("n,vocabulary", [(7, 1), (8, 1), (9, 1), (400, 2), (400, 3), (5000, 4), (3000, 50)])
def test_repeats_against_brute_force(n, vocabulary):
    ids = np.random.default_rng(n).integers(0, vocabulary, n)
    assert q.repeated_words(ids) == repeat_words(ids.tolist())


def test_order_changes_no_verdict(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), KIND + "").selectExpr("*", "doc_id as kept")
    want = {i for i, t in enumerate(texts()) if not any(r.rejects(q.Doc(t)) for r in q.RULES)}
    for rules in (q.RULES, q.RULES[::-1]):
        out = q.keep_good(docs, rules)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
    assert 6 in want and 10 not in want and 11 not in want


def test_cascade_orders_by_rejections_per_cost(spark):
    import time

    docs = spark.createDataFrame([(i, "a " * 50 + "b" * (i % 4)) for i in range(200)], KIND)
    never = q.Rule("never", lambda d: False)
    slow = q.Rule("slow", lambda d: bool(time.sleep(0.002)) or d.text.endswith("b"))
    fast = q.Rule("fast", lambda d: d.text.endswith("bb"))
    assert [r.name for r in q.plan_cascade(docs, [never, slow, fast], 100)] == ["fast", "slow", "never"]


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert q.keep_good(none).collect() == [] and q.judge(none).collect() == []


def test_column_names_differ_in_case(spark):
    rows = [("spam " * 100, 1, "one word after another makes up this short last column"), (" ".join(f"word{i}" for i in range(40)), 2, "")]
    docs = spark.createDataFrame(rows, "TEXT string, doc_id long, last string")
    assert [r["doc_id"] for r in q.keep_good(docs).collect()] == [2]
