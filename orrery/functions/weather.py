"""What weather allows, in coarse bands with stated limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the bands; limits of cloud base and visibility (metres), cloud cover (percent) and rain (mm).
UNKNOWN, ADVERSE, DEGRADED, GOOD = "INCONNU", "DÉFAVORABLE", "DÉGRADÉ", "FAVORABLE"
IMPASSABLE, HARD, PASSABLE = "IMPRATICABLE", "DIFFICILE", "PRATICABLE"
BASE_M, SIGHT_M, COVER = (600, 1500), (3000, 8000), 80
RAIN_24, RAIN_72 = (40, 12), (90, 35)


def _under(x: Column, limit: float) -> Column:
    return F.coalesce(x < limit, F.lit(False))


def _over(x: Column, limit: float) -> Column:
    return F.coalesce(x > limit, F.lit(False))


def observation_band(base_m: Column, sight_m: Column, cover: Column) -> Column:
    """How well one sees from the air. A null says nothing, so a missing value makes no band worse; without any it is unknown."""
    adverse, degraded = (_under(base_m, b) | _under(sight_m, s) for b, s in zip(BASE_M, SIGHT_M, strict=True))
    unknown = base_m.isNull() & sight_m.isNull() & cover.isNull()
    return F.when(unknown, UNKNOWN).when(adverse, ADVERSE).when(degraded | _over(cover, COVER), DEGRADED).otherwise(GOOD)


def mobility_band(rain_24: Column, rain_72: Column) -> Column:
    """How well unpaved roads carry after the rain of one and of three days; a single null is no rain, two are unknown."""
    impassable, hard = (_over(rain_24, a) | _over(rain_72, b) for a, b in zip(RAIN_24, RAIN_72, strict=True))
    return F.when(rain_24.isNull() & rain_72.isNull(), UNKNOWN).when(impassable, IMPASSABLE).when(hard, HARD).otherwise(PASSABLE)
