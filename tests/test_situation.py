"""The situation report as a row, connectivity of regions, and names of areas."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orrery import dims
from orrery.operators import reports, spatial

NOW = datetime(2024, 1, 31)
KIND = """event_id long, ts timestamp_ntz, ingested_at timestamp_ntz, status string, event_type string, province string, territory string, confidence double, priority long,
    independent_sources long, actors array<string>, fatalities long, fatalities_low long, fatalities_high long, displaced long, lat double"""


def event(i, hours, **given):
    ts = NOW - timedelta(hours=hours)
    row = dict(
        event_id=i, ts=ts, ingested_at=ts + timedelta(hours=1), status="unverified", event_type="clash", province="P", territory="T", confidence=0.6, priority=i, independent_sources=2,
        actors=["A"], fatalities=None, fatalities_low=None, fatalities_high=None, displaced=None, lat=1.0,
    )
    return tuple((row | given).values())


def test_a_report_by_hand(spark):
    rows = [
        event(1, 2, fatalities=3, fatalities_low=1), event(2, 3, status="confirmed", independent_sources=1, priority=99), event(3, 5, status="rejected"), event(4, 30),
        event(5, 6, confidence=0.3, lat=None), event(6, 7, province="Q"), event(7, 100, territory="U"),
    ]
    events = spark.createDataFrame(rows, KIND)
    (r,) = reports.sitrep(events, NOW, 24, "P").collect()
    assert (r["province"], r["period_start"], r["period_end"]) == ("P", NOW - timedelta(hours=24), NOW)
    assert (r["total"], r["confirmed"], r["unverified"], r["fatalities"], r["fatalities_low"]) == (3, 1, 2, 3, 1)
    assert [h["event_id"] for h in r["highlights"]] == [2, 1]
    assert {(t["kind"], t["label"], t["current"], t["previous"]) for t in r["trends"]} == {("type", "clash", 3, 1), ("place", "T", 3, 1)}
    assert [(a["actor"], a["current"], a["previous"]) for a in r["actors"]] == [("A", 3, 1)]
    assert [(g["gap"], g["n"], g["detail"]) for g in r["gaps"]] == [("silent", 1, "U"), ("single_family", 1, "of 3"), ("unlocated", 1, "of 3")]
    (none,) = reports.sitrep(events.where("false"), NOW).collect()
    assert none["total"] == 0 and none["province"] is None and none["trends"] == none["highlights"] == none["gaps"] == []


def test_connectivity(spark):
    hits = {"down": "001111", "up": "00111", "once": "0100", "calm": "000", "short": "0011"}
    rows = [(k, i, None if h == "0" and i == 0 else h == "1", k != "up") for k, x in hits.items() for i, h in enumerate(x)]
    got = {r["k"]: (r["status"], r["run"], r["drop"]) for r in reports.connectivity(spark.createDataFrame(rows, "k string, i int, hit boolean, drop boolean"), "k", ["i"]).collect()}
    assert got == {
        "down": (reports.DEGRADED, 4, True), "up": (reports.WATCHED, 3, False), "once": (reports.WATCHED, 0, True), "calm": (reports.NOMINAL, 0, None), "short": (reports.WATCHED, 2, True),
    }


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def test_names_of_areas(spark):
    rng = random.Random(4)
    places = [(i, f"n{i}", rng.uniform(-2, 2), rng.uniform(28, 31)) for i in range(120)]
    places += [(500, "twin", *places[0][2:])]
    areas = [(i, rng.uniform(-2, 2), rng.uniform(28, 31), rng.choice([5.0, 20.0, 60.0])) for i in range(150)] + [(900, *places[0][2:], 0.5), (901, None, 29.0, 5.0), (902, 1.0, 29.0, None)]
    got = spatial.named_areas(spark.createDataFrame(areas, "a int, lat double, lon double, radius_km double"), spark.createDataFrame(places, "feature int, label string, lat double, lon double"), "a")
    want = {}
    for a, la, lo, r in areas:
        near = sorted((km(la, lo, x, y), i, n) for i, n, x, y in places if la is not None and r is not None and km(la, lo, x, y) <= r)[:3]
        plain = None if la is None or r is None else f"{la:.3f}, {lo:.3f}"
        names = "–".join(n for *_, n in near)
        want[a] = (f"axe {names}" if len(near) > 1 else names or plain, len(near))
    assert {r["a"]: (r["name"], r["n"]) for r in got.collect()} == want
    assert want[900][1] == 2
    assert spatial.named_areas(spark.createDataFrame(areas[:1], "a int, lat double, lon double, radius_km double").where(F.lit(False)), spark.createDataFrame(places, "feature int, label string, lat double, lon double"), "a").count() == 0


def test_names_of_areas_meet_few_places(spark, monkeypatch):
    """Of 2,500 places within each area three name it; the pairs formed stay near what is kept, and the names are those of
    brute force, places at one position and areas smaller than the first circle among them."""
    places = [(i, f"P{i}", -1.0 + (i % 50) * 0.01, 29.0 + (i // 50) * 0.01) for i in range(2500)] + [(9000 + i, f"Q{i}", -0.9, 29.1) for i in range(400)]
    areas = [(i, -0.95 + i * 0.004, 29.05 + i * 0.003, 200.0 if i % 5 else 0.6) for i in range(100)] + [(200, 5.0, 29.0, 900.0), (201, -0.9, 29.1, 50.0)]
    pairs, plain = [], spatial.within_km

    def counted(*args):
        out = plain(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within_km", counted)
    got = spatial.named_areas(spark.createDataFrame(areas, "a int, lat double, lon double, radius_km double"), spark.createDataFrame(places, "feature int, label string, lat double, lon double"), "a")
    got = {r["a"]: (r["name"], r["n"]) for r in got.collect()}
    apart = lambda p, q: 2 * 6371.0 * math.asin(math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2))
    for i, la, lo, r in areas:
        near = sorted((apart((la, lo), p[2:]), p[0], p[1]) for p in places)[:3]
        assert got[i][1] == sum(k <= r for k, *_ in near)
        if got[i][1] > 1 and near[2][0] - near[1][0] > 1e-9 and near[1][0] - near[0][0] > 1e-9:
            assert got[i][0] == "axe " + "–".join(n for k, _, n in near if k <= r)
    assert sum(pairs) < 100 * len(areas)


def test_discs_that_no_settlement_reaches(spark):
    """Sampled or not, a disc has the persons of brute force: near, at the rim of and far from a settlement, small and wide."""
    discs = [(i, -1.5 + 0.03 * i, 29.1, [0.5, 3.0, 12.0][i % 3], "Northreach" if i % 2 else None) for i in range(40)] + [(90, 70.0, 29.1, 40.0, "Westvale"), (91, None, 1.0, 1.0, None)]
    got = spatial.with_population_at_risk(spark.createDataFrame(discs, "i int, lat double, lon double, radius_km double, province string"))
    got = {r["i"]: r["population_at_risk"] for r in got.collect()}

    def density(la, lo, province):
        total = dims.RURAL_DENSITY.get(province, dims.RURAL_DEFAULT)
        for _, y, x, pop, radius, *_ in dims.PLACES:
            sigma = max(2.0, radius * 0.8)
            h = math.sin(math.radians(y - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lo) / 2) ** 2
            km = 2 * 6371.0 * math.asin(math.sqrt(h))
            total += pop / (math.pi * max(1.0, radius) ** 2) * math.exp(-0.5 * (km / sigma) ** 2) if km <= 3 * sigma else 0.0
        return math.floor(total + 0.5)

    for i, la, lo, radius, province in discs[:-1]:
        r, total = max(1.0, radius), 0.0
        for ring in range(4):
            n = 8 if ring else 1
            m, ts = r * (ring + 0.5) / 4, [2 * math.pi * k / n for k in range(n)]
            mean = sum(density(la + m * math.cos(t) / 110.57, lo + m * math.sin(t) / (111.32 * math.cos(math.radians(la))), province) for t in ts) / n
            total += mean * r * r * math.pi * ((ring + 1) ** 2 - ring**2) / 16
        assert abs(got[i] - total) <= 0.51
    assert got[91] is None
