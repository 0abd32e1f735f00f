"""Scores, bands and significance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import CREDIBILITY_P, GRADE_P


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def round_half_up(x: Column) -> Column:
    """To the nearest integer, halves towards +infinity."""
    return F.floor(x + 0.5)


def poisson_significant(a: Column, b: Column) -> Column:
    """Two counts differ beyond chance."""
    return (a + b >= 5) & (F.abs(a - b) > 1.96 * F.sqrt((a + b).cast("double")))


def percent_change(now: Column, before: Column) -> Column:
    """0 from nothing to nothing, null from nothing to something."""
    return F.when(before == 0, F.when(now == 0, F.lit(0.0))).otherwise((now - before) * 100.0 / before)


def grade_of(mean: Column) -> Column:
    """Posterior mean as a reliability grade."""
    return (
        F.when(mean >= 0.90, "A").when(mean >= 0.75, "B").when(mean >= 0.58, "C").when(mean >= 0.33, "D").when(mean >= 0.10, "E").otherwise("F")
    )


def credibility_of(certainty: Column, located: Column, has_actors: Column, timed: Column) -> Column:
    """A report's own credibility from its certainty and how specific it is."""
    n = located.cast("int") + has_actors.cast("int") + timed.cast("int")
    return (
        F.when(certainty == "denied", 5)
        .when(certainty == "asserted", F.when(n >= 3, 2).when(n == 2, 3).otherwise(4))
        .when(certainty == "attributed", F.when(n >= 3, 3).otherwise(4))
        .otherwise(F.when(n >= 2, 4).otherwise(5))
    )


def look_up(key: Column, values: dict, default: object = None) -> Column:
    """A fixed mapping as an expression."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def grade_p(grade: Column) -> Column:
    return look_up(grade, GRADE_P)


def credibility_p(credibility: Column) -> Column:
    return look_up(credibility, CREDIBILITY_P)


def time_similarity(gap_min: Column, unc_a: Column, unc_b: Column) -> Column:
    sigma = F.greatest(F.lit(30.0), F.hypot(unc_a.cast("double"), unc_b.cast("double")))
    return F.exp(-0.5 * F.pow(gap_min / sigma, F.lit(2.0)))


def place_similarity(km: Column, radius_a: Column, radius_b: Column) -> Column:
    """Null where the distance is."""
    return F.exp(-0.5 * F.pow(km / F.greatest(F.lit(3.0), F.hypot(radius_a, radius_b)), F.lit(2.0)))


def casualty_similarity(a: Column, b: Column) -> Column:
    """Agreement of two counts in magnitude; null where one is missing."""
    ratio = F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0))
    banded = F.when(ratio > 0.5, 1.0).when(ratio > 0.25, 0.6).when(ratio > 0.1, 0.25).otherwise(0.0)
    return F.when(a.isNull() | b.isNull(), None).when(F.greatest(a, b) == 0, 1.0).otherwise(banded)


def excess_llr(observed: Column, expected: Column, total: Column, least: float = 3.0) -> Column:
    """Poisson log-likelihood ratio of an excess inside a cylinder; 0 below ``least`` observations."""
    out_obs, out_exp = total - observed, total - expected
    inside = observed * F.ln(observed / expected)
    outside = F.when((out_obs > 0) & (out_exp > 0), out_obs * F.ln(out_obs / out_exp)).otherwise(0.0)
    return F.when((observed >= least) & (observed > expected) & (expected > 0), inside + outside).otherwise(0.0)


def confidence_band(c: Column, high: float = 0.75, low: float = 0.45) -> Column:
    return F.when(c >= high, "high").when(c >= low, "medium").otherwise("low")


def report_band(c: Column) -> Column:
    return F.when(c >= 0.85, "very high").when(c >= 0.65, "high").when(c >= 0.45, "medium").otherwise("low")
