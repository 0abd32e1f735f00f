"""Reliability of sources, confidence in events, and their priority."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.geo import haversine_km
from ..functions.stats import clamp, credibility_p, grade_of, grade_p, logit, look_up, sigmoid
from .feed import age_hours
from .series import decayed

# Base rate, band of automatic confidence, and weights of certainty.
PRIOR, LOW, HIGH = 0.45, 0.05, 0.93
CERTAINTY = {"asserted": 1.0, "attributed": 0.85, "hedged": 0.45, "denied": -0.9}


def posterior(sources: DataFrame, observations: DataFrame, keys: list[str], now: datetime) -> DataFrame:
    """sources (the keys, grade, strength) with mean, sd, n and the posterior's grade: Beta counts of the grade's prior
    and of decayed observations (the keys, correct, weight, at)."""
    return posterior_of_sums(sources, decayed(observations, keys, now), keys)


def posterior_of_sums(sources: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """``posterior`` from the decayed sums (the keys, alpha, beta, n) of the observations."""
    seen = sums.withColumnsRenamed({"alpha": "_a", "beta": "_b", "n": "_n"})
    p0 = grade_p(F.col("grade"))
    rows = sources.join(seen, keys, "left").withColumns({"_a": F.coalesce("_a", F.lit(0.0)) + p0 * F.col("strength"), "_b": F.coalesce("_b", F.lit(0.0)) + (1 - p0) * F.col("strength")})
    total = F.col("_a") + F.col("_b")
    return rows.withColumns(
        {"mean": F.col("_a") / total, "sd": F.sqrt(F.col("_a") * F.col("_b") / (total * total * (total + 1))), "n": F.coalesce("_n", F.lit(0.0)), "posterior_grade": grade_of(F.col("_a") / total)}
    ).drop("_a", "_b", "_n")


def report_llr(mean: Column, sd: Column, credibility: Column, agreement: Column) -> Column:
    """Evidence of one report in log-odds."""
    p = clamp(0.5 + (mean - 0.5) * (0.4 + 0.6 * credibility_p(credibility)), LOW, HIGH)
    sure = (
        F.when((credibility == 5) & (agreement == "contradict"), CERTAINTY["denied"])
        .when(credibility >= 5, CERTAINTY["hedged"])
        .when(credibility == 4, CERTAINTY["attributed"])
        .otherwise(CERTAINTY["asserted"])
    )
    x = (logit(p) - logit(F.lit(PRIOR))) * (1 - F.least(F.lit(0.6), sd * 1.6)) * sure
    return F.when(agreement == "contradict", -F.abs(x) * 0.8).when(agreement == "partial", x * 0.6).otherwise(x)


def coherence(n_located: Column, km: Column, n: Column, hours: Column) -> Column:
    """Log-odds for how near in place and time an event's reports are."""
    place = F.when(n_located < 2, 0.0).when(km <= 5, 0.28).when(km <= 20, 0.12).when(km <= 50, 0.0).otherwise(-0.35)
    time = F.when(n < 2, 0.0).when(hours <= 3, 0.22).when(hours <= 12, 0.10).when(hours <= 36, 0.0).otherwise(-0.25)
    return F.when(n >= 2, place + time).otherwise(0.0)


def fuse(reports: DataFrame, now: datetime, key: str = "event_id") -> DataFrame:
    """key, confidence, independent_sources, effective_n. ``reports``: key, report_id, family, mean, sd, credibility,
    agreement, report_confidence, published_at, ts, lat, lon, decision. A family's k-th report (by its own confidence)
    weighs the family's correlation to the power of k. Distances come from an event's distinct positions."""
    k = F.row_number().over(Window.partitionBy(key, "family").orderBy(F.col("report_confidence").desc(), "report_id")) - 1
    w = F.pow(look_up(F.col("family"), dims.FAMILY_RHO, 1.0), k)
    rows = reports.withColumn("_w", w).withColumn("_x", F.col("_w") * report_llr(F.col("mean"), F.col("sd"), F.col("credibility"), F.col("agreement")))
    at = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    e = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("x"), F.sum("_w").alias("effective_n"), F.count_distinct("family").alias("independent_sources"),
        F.count(at).alias("located"), F.collect_set(at).alias("at"), (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 3.6e9).alias("hours"),
        F.max("published_at").alias("newest"), F.max("decision").alias("decision"),
    )
    far = lambda p: F.array_max(F.transform("at", lambda q: haversine_km(p["lat"], p["lon"], q["lat"], q["lon"])))
    km = F.coalesce(F.array_max(F.transform("at", far)), F.lit(0.0))
    families = F.when(F.col("independent_sources") >= 2, 0.42 * F.ln("independent_sources")).otherwise(0.0)
    age = age_hours(F.col("newest"), now)
    stale = F.when((F.col("effective_n") < 2) & (age > 24), F.least(F.lit(0.85), 0.18 * F.log2(age / 24 + 1))).otherwise(0.0)
    odds = logit(F.lit(PRIOR)) + F.col("x") + families + coherence(F.col("located"), km, F.col("n"), F.col("hours")) - stale
    c = F.when(F.col("decision") == "confirm", 0.97).when(F.col("decision") == "reject", 0.03).otherwise(clamp(sigmoid(odds), LOW, HIGH))
    return e.select(key, c.alias("confidence"), "independent_sources", "effective_n")


def priority(severity: Column, fatalities: Column, injured: Column, at_risk: Column, ts: Column, confidence: Column, now: datetime) -> Column:
    """0 to 100: severity, casualties, people at risk and recency, weighed by confidence."""
    dead = F.least(F.lit(1.0), (F.coalesce(fatalities, F.lit(0)) + 0.4 * F.coalesce(injured, F.lit(0))) / 25)
    people = F.least(F.lit(1.0), F.log10(1 + F.coalesce(at_risk, F.lit(0))) / 5)
    recent = F.exp(-F.greatest(F.lit(0.0), age_hours(ts, now)) / 72)
    raw = 0.34 * severity + 0.22 * dead + 0.18 * people + 0.26 * recent
    return F.floor(100 * raw * (0.35 + 0.65 * confidence) + 0.5).cast("long")


def status(decision: Column, agree: Column, contradict: Column, families: Column, confidence: Column) -> Column:
    """A decision wins; then dispute, then corroboration. agree, contradict: numbers of reports."""
    disputed, backed = (contradict > 0) & (contradict * 2 >= agree), (families >= 2) & (confidence >= 0.6)
    decided = F.when(decision == "confirm", "confirmed").when(decision == "reject", "rejected")
    return decided.when(disputed, "disputed").when(backed, "corroborated").otherwise("unverified")
