"""The classifier, the scanner of names and half-space trees: by hand, and against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from orrery.functions.text import fold_key
from orrery.operators.anomaly import half_space_scores, half_spaces
from orrery.operators.classify import classified
from orrery.operators.numbering import numbered
from orrery.operators.reports import brief, review_states
from orrery.operators.scanner import edits, longest_matches


def kinds(spark, *rows):
    x = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, actors array<string>, dead int, hurt int, taken int, moved int")
    out = classified(x, fold_key(F.col("text")), *[F.col(c) for c in ("actors", "dead", "hurt", "taken", "moved")], name="c")
    return [r.c for r in out.orderBy("i").collect()]


def test_types(spark):
    none = (None, None, None, None)
    got = kinds(
        spark,
        ("Pillage d'un marché", None, *none),
        ("Match de football à la ville", ["Grey Column"], *none),
        ("Match de football, pillage", None, *none),
        (None, None, *none),
        ("", ["Nobody", None], *none),
        ("Accalmie", None, *none),
        ("Tirs", ["Grey Column", "Third Brigade", "Third Brigade"], 9, None, None, None),
        ("Rien", [], 9, None, None, None),
    )
    assert [c.type for c in got] == ["looting", "unknown", "looting", "unknown", "unknown", "armed_clash", "armed_clash", "massacre"]
    assert got[0].evidence == ["pillage"] and got[0].score == 1.0 and got[3].score == 0.0 and got[3].evidence == []
    assert [a.type for a in got[6].alts] == ["massacre", "troop_movement"]


def test_edits():
    assert [edits(*x) for x in (("amaro", "amaro", 1), ("amaro", "maaro", 1), ("amaro", "amar", 1), ("amaro", "esker", 2), ("ca", "abc", 3), ("", "ab", 2))] == [0, 1, 1, 3, 3, 2]


def plain_scan(words, entities):
    """Spans from the longest, left to right, taking words that are free."""
    taken, out = set(), []
    owner = {}
    for i, names in enumerate(entities):
        for n in names:
            owner.setdefault(n, i)
    for span in range(min(4, len(words)), 0, -1):
        for i in range(len(words) - span + 1):
            where, phrase = set(range(i, i + span)), " ".join(words[i : i + span])
            if where & taken:
                continue
            if phrase in owner:
                out.append((i, i + span, owner[phrase], 1.0, phrase))
                taken |= where
            elif span == 1 and len(phrase) >= 5:
                most, best = (1 if len(phrase) <= 8 else 2), None
                for e, names in enumerate(entities):
                    if any(n[:1] == phrase[0] for n in names):
                        for n in names:
                            if " " not in n and edits(phrase, n, most) <= most and (best is None or edits(phrase, n, most) < best[0]):
                                best = (edits(phrase, n, most), e)
                if best:
                    out.append((i, i + 1, best[1], round(1 - 0.2 * best[0], 6), phrase))
                    taken |= where
    return sorted(out)


def test_scanner(spark):
    entities = [["amaro", "amaro ville"], ["ville haute", "beltane", "x"], ["haute mer nord est", "amarillo"], ["amaro", "corvo sud"], ["garrowfields"]]
    rng, vocabulary = random.Random(3), "amaro amraro amaor ville haute mer nord est beltane beltame bletane corvo sud garowfeilds gar x amarilo".split()
    texts = [[], None, ["x"]] + [[rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, w array<string>")
    keys = spark.createDataFrame([(i, n, k) for i, names in enumerate(entities) for n, k in enumerate(names)] + [(9, 0, "")], "ord int, n int, key string")
    got: dict = {}
    for r in longest_matches(rows, keys, "id", "w").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.ord, round(r.score, 6), r.phrase))
    for i, words in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_scan(words or [], entities), words
    assert longest_matches(rows.limit(0), keys, "id", "w").count() == 0 == longest_matches(rows, keys.limit(0), "id", "w").count()


def test_numbered(spark):
    rows = spark.createDataFrame([("a", i % 50) for i in range(400)] + [("b", 1), (None, 3), (None, 2)], "k string, o int")
    got = [tuple(r) for r in numbered(rows, ["k"], ["o"]).collect()]
    for k, size in (("a", 400), ("b", 1), (None, 2)):
        mine = sorted((n, o) for kk, o, n in got if kk == k)
        assert [n for n, _ in mine] == list(range(1, size + 1)) and [o for _, o in mine] == sorted(o for _, o in mine)


def test_half_spaces(spark):
    rng, window, depth, trees = np.random.default_rng(1), 20, 4, 5
    x = [("k", i, float(rng.random() / 5), float(rng.random() / 5)) for i in range(70)] + [("k", 70, 0.95, 0.97), ("l", 0, 0.5, None)]
    rows = spark.createDataFrame(x, "k string, o int, a double, b double")
    got = {(r.k, r.o): r.score for r in half_space_scores(rows, "k", "o", ["a", "b"], trees, depth, window, 7).collect()}
    dim, split = half_spaces(2, trees, depth, 7)
    known, latest = np.zeros(dim.shape), np.zeros(dim.shape)
    for n in range(71):
        if n and n % window == 0:
            known, latest = latest, np.zeros(dim.shape)
        total = 0.0
        for t in range(trees):
            at = 0
            for level in range(depth + 1):
                total += known[t, at] * 2**level
                latest[t, at] += 1
                at = 2 * at + (1 if x[n][2 + dim[t, at]] < split[t, at] else 2) if level < depth else at
        want = None if n < window else 1 - total / (trees * window * (2 ** (depth + 1) - 1))
        assert got["k", n] is None if want is None else abs(got["k", n] - want) < 1e-9
    assert got["l", 0] is None and got["k", 70] > max(got["k", n] for n in range(window, 70))


def test_brief(spark):
    kinds = "id long, title string, entities array<string>, meta string, body string, updated_at long, status string, confidence string, sources int, illustrative boolean"
    rows = [
        (1, "Copper prices", ["Mine"], "en", "copper", 5, "draft", "high", 1, False),
        (2, "Copper roads", [], None, None, 9, "disputed", "high", 2, False),
        (3, "Copper", None, "", "copper", 1, "verified", "low", 0, False),
        (4, "Tin", ["copper"], "", "", 2, "in_review", "low", 3, True),
        (5, "Nothing", [], "", "", 3, "draft", "low", 1, False),
    ]
    x = spark.createDataFrame(rows, kinds)
    got = brief(x, "Copper quotas?").first()
    assert (got.found, got.usable, got.verified, got.disputed, got.unsourced, got.illustrative) == (4, 2, 1, 1, 1, 1)
    assert got.findings == [1, 3, 2, 4] and got.unresolved == [1, 2] and got.missed == ["quotas"] and got.level == "high"
    assert got.steps == ["add_sources", "second_source", "settle_dispute", "submit_drafts", "approve_brief"]
    assert brief(x.where("id <> 3"), "Copper quotas?").first().level == "medium"
    none = brief(x, "Quotas?").first()
    assert (none.found, none.level, none.findings, none.missed, none.steps) == (0, "none", [], ["quotas"], ["open_record"])


def test_review_states(spark):
    log = [
        (1, 1, "submit", "a", "operator", None), (1, 2, "create", "a", "operator", None), (1, 3, "submit", "a", "operator", None), (1, 4, "approve", "a", "operator", None),
        (1, 5, "return", "b", "operator", " "), (1, 6, "approve", "b", "analyst", None), (1, 7, "approve", "c", "operator", None), (1, 8, "submit", "a", "operator", None),
        (2, 1, "create", "a", None, None), (2, 2, "approve", "b", "operator", None), (2, 3, "submit", "a", None, None), (2, 4, "return", "b", "operator", "why"), (2, 5, "approve", "b", "operator", None),
        (3, 1, "create", "a", None, None), (3, 2, "submit", None, None, None), (3, 3, "approve", "b", "operator", None), (3, 4, "version", "b", "operator", None), (3, 5, None, None, None, None),
        (4, 1, "approve", "b", "operator", None),
    ]
    got = review_states(spark.createDataFrame(log, "report_id int, seq int, action string, actor string, level string, note string")).collect()
    want = {1: (1, "approved", "a", "c"), 2: (1, "draft", "a", None), 3: (2, "draft", "b", None), 4: (0, None, None, None)}
    assert {r.report_id: (r.versions, r.state, r.author, r.reviewer) for r in got} == want
