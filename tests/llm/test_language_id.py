import math
import random

import pytest

from orrery.llm import language_id as lid

WORDS = {"en": "the and of that with this from have".split(), "de": "der und nicht eine werden schön für über".split(), "fr": "les des une été avec pour être où".split()}
KIND = "doc_id long, text string, declared string, host string"


def text(rng, g, n=40):
    return " ".join(rng.choice(WORDS[g]) for _ in range(n))


@pytest.fixture(scope="module")
def models(spark):
    rng = random.Random(1)
    rows = [(text(rng, g), g) for g in WORDS for _ in range(60)] + [(None, "de"), ("x", None)]
    return lid.fit(spark.createDataFrame(rows, "text string, lang string"))


def found(spark, models, rows):
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as logs", "2 as own", "3 as prior")
    return {r["doc_id"]: r for r in lid.identify(docs, models, ["doc_id"]).collect()}


def test_held_out_accuracy(spark, models):
    rng = random.Random(2)
    rows = [(i, text(rng, g := rng.choice(list(WORDS))), None, None) for i in range(200)]
    want = {i: max(WORDS, key=lambda g: sum(w in WORDS[g] for w in t.split())) for i, t, *_ in rows}
    got = found(spark, models, rows)
    assert sum(got[i]["lang"] == want[i] for i in want) >= 198


def test_evidence_decides_where_the_text_does_not(spark, models):
    rng = random.Random(3)
    rows = [(i, text(rng, "de"), "de", f"a{i % 3}.example.de") for i in range(60)]
    rows += [(100 + i, text(rng, "fr"), "fr", "b.example.fr") for i in range(30)]
    rows += [
        (1000, "", "fr", None),
        (1001, None, None, "b.example.fr"),
        (1002, "7 8", None, "a0.example.de"),
        (1003, None, None, "new.example.de"),
        (1004, None, None, None),
        (1005, text(rng, "en"), "fr", "b.example.fr"),
        (1006, None, "xx", "localhost"),
        (1007, f"<html lang=de><script>{text(rng, 'en')}</script><p>{text(rng, 'de')}</p>", None, None),
    ]
    got = found(spark, models, rows)
    assert [got[i]["lang"] for i in (1000, 1001, 1002, 1003, 1005, 1007)] == ["fr", "fr", "de", "de", "en", "de"]
    assert got[1004]["lang"] == got[1006]["lang"] == "de"  # the most frequent
    assert got[1004]["text_lang"] is None and len(got) == len(rows)
    assert all(0 < r["confidence"] <= 1 + 1e-9 for r in got.values())


def test_equal_rows_and_empty_tables(spark, models):
    rows = [(1, "the and of", "en", "h.example.com")] * 3
    docs = spark.createDataFrame(rows, KIND)
    assert len(set(lid.identify(docs, models, ["doc_id"]).collect())) == 1
    assert lid.identify(docs.limit(0), models, ["doc_id"]).collect() == []


def test_without_labels_there_are_no_languages(spark):
    none = lid.fit(spark.createDataFrame([], "text string, lang string"))
    docs = spark.createDataFrame([(1, "the and of", "en", "h.example.com"), (None, None, None, None)], KIND)
    got = {tuple(r) for r in lid.identify(docs, none, ["doc_id"]).collect()}
    assert got == {(1, None, None, None), (None, None, None, None)}


def plainly(models, rows):
    """Brute force: lang and confidence of rows (id, text, declared, host), by loops over lists of numbers."""
    n, strength = len(models.languages), lid.STRENGTH
    logs = [list(models.evidence(lid.visible(t))) for _, t, _, _ in rows]

    def shares(xs):
        e = [math.exp(x - max(xs)) for x in xs]
        return [x / sum(e) for x in e]

    soft = [shares(x) if min(x) < 0 else [0.0] * n for x in logs]
    total = lambda some: [sum(soft[i][k] for i in some) for k in range(n)]
    mixed = lambda counts, prior: [(max(c, 0.0) + p * strength) / (sum(max(x, 0.0) for x in counts) + strength) for c, p in zip(counts, prior, strict=True)]
    base = mixed(total(range(len(rows))), [1 / n] * n)
    hosts = [r[3] for r in rows]
    domain = lambda h: ".".join(h.split(".")[-2:]) if "." in h else h
    out = {}
    for i, (key, _, declared, host) in enumerate(rows):
        less = lambda some: [a - b for a, b in zip(total(some), soft[i], strict=True)]  # noqa: B023, E731
        prior = base
        if host is not None:
            if "." in host:
                end = host.split(".")[-1]
                prior = mixed(less([j for j, h in enumerate(hosts) if h and "." in h and h.split(".")[-1] == end]), prior)
            prior = mixed(less([j for j, h in enumerate(hosts) if h is not None and domain(h) == domain(host)]), prior)
            prior = mixed(less([j for j, h in enumerate(hosts) if h == host]), prior)
        odds = [a + math.log(p) for a, p in zip(logs[i], prior, strict=True)]
        if declared in models.languages:
            named = [lid.NAMED if g == declared else (1 - lid.NAMED) / (n - 1) for g in models.languages]
            told = mixed(less([j for j, r in enumerate(rows) if r[2] == declared]), named)
            odds = [a + math.log(p / q) for a, p, q in zip(odds, told, base, strict=True)]
        p = shares(odds)
        out[key] = (models.languages[p.index(max(p))], max(p))
    return out


def test_against_brute_force(spark, models):
    rng = random.Random(8)
    hosts = [None, "localhost", "a.example.de", "b.example.de", "c.example.fr", "x.other.fr", "y.other.com"]
    rows = [(i, text(rng, rng.choice(list(WORDS)), rng.choice([0, 1, 3, 30])), rng.choice([None, "de", "fr", "xx"]), rng.choice(hosts)) for i in range(120)]
    want, got = plainly(models, rows), found(spark, models, rows)
    assert len(got) == len(rows)
    for key, (lang, sure) in want.items():
        assert got[key]["confidence"] == pytest.approx(sure, abs=1e-9) and got[key]["lang"] == lang


def test_markup(spark):
    pages = spark.createDataFrame(
        [('<!DOCTYPE html><HTML class=a LANG="de-AT">', "https://A.b.Example.org/x"), ("<html lang=fr>", "x"), ("<p>", None), (None, "")], "html string, url string"
    )
    got = pages.select(lid.declared_in(pages["html"]), lid.host_of(pages["url"])).collect()
    assert [tuple(r) for r in got] == [("de", "a.b.example.org"), ("fr", None), (None, None), (None, None)]


def test_every_language_is_fitted_on_its_different_texts(spark):
    """Many copies of few texts: each language is known, and a copy tells no more than its text."""
    rng = random.Random(5)
    few = [(f"{g} {text(rng, 'de')}", g) for g in (f"l{i}" for i in range(12))]
    many = [(text(rng, "en"), "en") for _ in range(900)]
    copied = spark.createDataFrame(few * 900 + many, "text string, lang string")
    got, want = lid.fit(copied), lid.fit(spark.createDataFrame(few + many, "text string, lang string"))
    assert got.languages == want.languages == sorted({g for _, g in few} | {"en"})
    assert (got.logs == want.logs).all()
    picked = lid.fit(copied, rows=1)
    assert picked.languages == got.languages


def test_plain_text_keeps_what_angle_brackets_hold(spark, models):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    t = f"{text(rng, 'en', 4)} 1 < 2 {text(rng, 'fr')} 3 > 2"
    docs = spark.createDataFrame([(1, t, None, None, False), (2, t, None, None, True)], KIND + ", markup boolean")
    got = {r["doc_id"]: r["text_lang"] for r in lid.identify(docs, models, ["doc_id"], F.col("markup")).collect()}
    assert got == {1: "fr", 2: "en"}
