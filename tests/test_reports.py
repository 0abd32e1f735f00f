"""Decisions, extraction's edges, and the selection of the scan, by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orrery.functions.text import fold_key, tokens
from orrery.operators import adjudicate, anomaly, extract, scanner

AT = datetime(2024, 1, 1)


def test_credits_and_history(spark):
    decided = spark.createDataFrame([(1, "confirm", AT), (2, "reject", AT), (3, "edit", AT)], "event_id long, action string, at timestamp_ntz")
    reports = [(1, "press", "@a", "agree"), (1, "press", None, "contradict"), (1, "radio", None, "partial"), (2, "radio", "@b", "contradict"), (2, "radio", "@b", None), (3, "press", "@a", "agree")]
    new = adjudicate.credits(decided, spark.createDataFrame(reports, "event_id long, source_type string, handle string, agreement string"))
    got = sorted((r["source_type"], r["handle"] or "", r["correct"], r["weight"]) for r in new.collect())
    assert got == [("press", "", False, 1.0), ("press", "@a", True, 1.0), ("radio", "", True, 0.5), ("radio", "@b", False, 1.0), ("radio", "@b", True, 1.0)]
    keys = [r["key"] for r in adjudicate.observe(new).collect()]
    assert sorted(keys) == ["press", "press", "press:@a", "radio", "radio", "radio", "radio:@b", "radio:@b"]
    old = spark.createDataFrame([("press", True, 1.0, datetime(2020, 1, i + 1)) for i in range(20)], "key string, correct boolean, weight double, at timestamp_ntz")
    assert adjudicate.observe(new, old, most=5).where("key = 'press'").where(F.year("at") == 2024).count() == 2
    assert adjudicate.observe(new, old, most=5).where("key = 'press'").count() == 5


def test_merge_and_dismiss(spark):
    events = spark.createDataFrame([(i, "unverified") for i in range(1, 6)], "event_id long, status string")
    merges = spark.createDataFrame([(1, 2), (1, 1), (9, 3), (4, 5)], "event_id long, other_id long")
    got, reports = adjudicate.merge(events, events.select("event_id"), merges)
    assert {(r["event_id"], r["status"], r["published_as"]) for r in got.collect()} == {(1, "unverified", 1), (2, "merged", 1), (3, "unverified", 3), (4, "unverified", 4), (5, "merged", 4)}
    assert sorted(r["event_id"] for r in reports.collect()) == [1, 1, 3, 4, 4]
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    assert [(r["a"], r["b"]) for r in adjudicate.undismissed(pairs, spark.createDataFrame([(4, 3), (2, 1)], "a long, b long")).collect()] == [(5, 6)]


CASES = {
    "au moins douze civils tués": (12, None),
    "tués: 12, blessés 3 et 40": (12, 12),
    "morts au nombre de 7": (None, None),
    "5 morts, 9 morts": (9, None),
    "blessés": (None, None),
    "": (None, None),
    "deux cents otages": (None, None),
}


def test_casualties(spark):
    """The nearest number before a cue, up to four words, else after it, up to three; the largest of a field."""
    rows = spark.createDataFrame([(k, *v) for k, v in CASES.items()] + [(None, None, None)], "text string, dead long, hurt long")
    x = rows.withColumn("w", tokens(fold_key(F.coalesce("text", F.lit(""))))).withColumn("n", F.transform("w", extract.numeral))
    for r in x.select("*", *[c.alias(k) for k, c in extract.casualties(F.col("w"), F.col("n")).items()]).collect():
        assert (r["fatalities"], r["injured"]) == (r["dead"], r["hurt"]), r["text"]


def test_extract_takes_anything(spark):
    rows = [(1, None, AT), (1, "", AT), (None, "Amaro", AT), (2, "Amaro", AT), (2, "Amaro", AT), (3, "nothing " * 3000, None)]
    got = extract.extract(spark.createDataFrame(rows, "id long, text string, created_at timestamp_ntz").selectExpr("*", "1 as start", "2 as ord")).collect()
    assert len(got) == len(rows) and sum(r["location"] is not None for r in got) == 3
    assert all(r["actors"] == [] and r["fatalities"] is None for r in got)


def test_matches_keep_every_row(spark):
    """Equal keys with different texts, and equal rows: each has its own matches."""
    texts = spark.createDataFrame([(1, ["red", "fox"]), (1, ["blue"]), (1, ["red", "fox"]), (None, ["red", "fox"])], "id long, w array<string>")
    keys = spark.createDataFrame([(0, 0, "red fox")], "ord long, n long, key string")
    assert sorted((r["id"] or 0, r["phrase"]) for r in scanner.matches_in(texts, keys, "w").collect()) == [(0, "red fox"), (1, "red fox"), (1, "red fox")]


def test_scan_selects_apart():
    row = lambda c, r, llr, o=10.0, e=1.0: {"centre": c, "radius_km": r, "hours": 24, "observed": o, "expected": e, "llr": llr}
    found = [row("Amaro", 8, 9.0), row("Amaro", 15, 8.0), row("Garrow", 8, 7.0, 2.0, 1.0), row("Corvo", 40, 6.0), row("Esker", 8, 1.0, 3.1, 1.0)]
    got = anomaly.apart(found, [5.0] * 18 + [10.0], 5)
    assert [(c["centre"], c["significant"]) for c in got] == [("Amaro", False), ("Corvo", False), ("Esker", False)]
    assert [c["p_value"] for c in got] == [0.1, 0.1, 1.0]
    assert anomaly.apart(found, [], 1)[0]["centre"] == "Amaro"
    near = anomaly.apart([row("Amaro", 8, 9.0), row("Garrow", 200, 8.0)], [], 5)
    assert [c["centre"] for c in near] == ["Amaro"]


def test_texts_once(spark):
    """Equal texts are read once, whatever their number: each report gets its own time and all that the text says."""
    seen = []

    def also(said):
        seen.append(said.count())
        return said.withColumn("long", F.size("words") > 3)

    texts = ["Deux morts lundi a Goma", "hier a 14h30", "il y a 3 heures", "vers 9h", "", None]
    rows = [(i, texts[i % 6], datetime(2024, 1, 1 + i % 9, 12)) for i in range(90)]
    got = extract.extract(spark.createDataFrame(rows, "id long, text string, created_at timestamp_ntz").withColumn("fatalities", F.lit(7)), also=also).collect()
    assert seen == [5] and len(got) == 90
    monday = lambda t: t - timedelta(days=t.weekday() or 7)
    for r in got:
        t = r["created_at"]
        day = t.replace(hour=0)
        want = [(monday(t), 720), (day - timedelta(days=1) + timedelta(hours=14, minutes=30), 45), (t - timedelta(hours=3), 45), (day + timedelta(hours=9), 60), None, None][r["id"] % 6]
        assert (None if r["when"] is None else tuple(r["when"])) == want
        assert r["fatalities"] == (2 if r["id"] % 6 == 0 else None) and r["long"] == (len((r["text"] or "").split()) > 3)
