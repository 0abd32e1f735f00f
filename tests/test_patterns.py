import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import geo
from orrery.operators import classify, patterns


def test_found(spark):
    words = ["ab", "b", "abc", "b", "zz"]
    texts = [None, "", "xabcx", "b", "q", "a" * 50_000 + "b"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", patterns.found(words)(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: [j for j, w in enumerate(words) if t and w in t] for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        patterns.found(["a", ""])


def test_cues_as_a_loop_finds_them():
    rng = random.Random(1)
    words = [*classify._WORDS, "calme", "eau", "route"]
    for _ in range(500):
        t = " ".join(rng.choices(words, k=rng.randrange(8)))
        cues = [next((c for c in cues if c in t), None) for *_, cues in classify.RULES]
        cuts = [any(c in t for c in cues) for _, cues in classify.SUPPRESSORS]
        assert classify._cues_of(t) == (cues, cuts, any(c in t for c in classify.OFF_TOPIC))


def test_grid_of_known_points(spark):
    points = [
        (48.24949, 16.41450, "33UXP0500"),  # Vienna
        (38.8977, -77.0365, "18SUJ2339"),  # Washington
        (60.3930, 5.3242, "32VK"),  # Bergen, in the wider zone
        (78.2232, 15.6267, "33XWG"),  # Longyearbyen
        (21.4097, -157.9160, "4QFJ12"),  # Honolulu
        (0.0, 0.0, "31NAA66021"),
    ]
    rows = spark.createDataFrame([p[:2] for p in points] + [(85.0, 0.0), (None, 1.0), (10.0, 181.0)], "lat double, lon double")
    got = rows.select("lat", geo.mgrs(F.col("lat"), F.col("lon")).alias("g"), geo.mgrs(F.col("lat"), F.col("lon"), 0).alias("short")).collect()
    for (lat, _, start), r in zip(points, got, strict=False):
        assert r["lat"] == lat and r["g"].startswith(start) and len(r["g"]) == len(r["short"]) + 10 and r["g"].startswith(r["short"]), r
    assert all(r["g"] is None for r in got[len(points) :])
    with pytest.raises(ValueError):
        geo.mgrs(F.col("lat"), F.col("lon"), 6)
