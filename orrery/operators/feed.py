"""Filters, queues and orderings over fused events.

An event table has (at least, where an operator reads them): event_id, ts, event_type, category, status, province,
territory, place, actors, description, handle, origin, fatalities, confidence, priority, independent_sources, decision.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unmark

# Hours of the named ranges; None is open.
RANGES = {"24h": 24, "72h": 72, "7d": 168, "30d": 720, "all": None}
ALERT_PRIORITY, TRIAGE_PRIORITY, TRIAGE_AGE_H = 55, 45, 96


def timestamp(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def hours_before(now: datetime, hours: float) -> Column:
    return F.timestamp_add("SECOND", F.lit(-int(hours * 3600)), timestamp(now))


def age_hours(ts: Column, now: datetime) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, timestamp(now)) / 3.6e9


def is_active(status: Column) -> Column:
    return ~status.isin("merged", "rejected")


def active(events: DataFrame) -> DataFrame:
    return events.where(is_active(F.col("status")))


def in_range(ts: Column, named: str, now: datetime) -> Column:
    hours = RANGES[named]
    return F.lit(True) if hours is None else ts >= hours_before(now, hours)


def matches_all(text: Column, query: str) -> Column:
    """Every word of the query occurs in the text, without regard to case and marks."""
    out = F.lit(True)
    for word in query.split():
        out &= F.contains(unmark(text), unmark(F.lit(word)))
    return out


def filter_feed(
    events: DataFrame, now: datetime, named: str = "all", query: str = "", category: str | None = None,
    status: str | None = None, province: str | None = None, hide_simulated: bool = False,
) -> DataFrame:
    """Active events of a range that pass every given filter, the newest first."""
    out = active(events).where(in_range(F.col("ts"), named, now))
    for column, wanted in (("category", category), ("status", status), ("province", province)):
        if wanted:
            out = out.where(F.col(column) == wanted)
    if hide_simulated:
        out = out.where(F.col("origin") != "simulated")
    if query.strip():
        parts = [F.coalesce(c, F.lit("")) for c in ("description", "place", "province", "territory")]
        hay = F.concat_ws(" ", *parts, F.array_join("actors", " "), F.coalesce("handle", F.lit("")))
        out = out.where(matches_all(hay, query))
    return out.orderBy(F.col("ts").desc(), F.col("event_id"))


def origin_of(simulated: Column, total: Column) -> Column:
    """Of an event with so many simulated reports among all."""
    return F.when(simulated == 0, "collected").when(simulated == total, "simulated").otherwise("mixed")


def is_simulated(source_id: Column) -> Column:
    return source_id.startswith("syn-") | source_id.startswith("telecom:")


def needs_triage(now: datetime) -> Column:
    """No decision yet, and disputed, or recent and either urgent or of a single family and grave."""
    age, dead = age_hours(F.col("ts"), now), F.coalesce("fatalities", F.lit(0))
    alone = (F.col("independent_sources") == 1) & ((dead >= 3) | (F.col("priority") >= 30))
    pressing = (age <= TRIAGE_AGE_H) & ((F.col("priority") >= TRIAGE_PRIORITY) | alone)
    undecided = F.col("decision").isNull() | (F.col("decision") == "edit")
    return undecided & (F.col("status") != "merged") & ((F.col("status") == "disputed") | pressing)


def queue(events: DataFrame, kind: str, now: datetime, alert: int = ALERT_PRIORITY) -> DataFrame:
    """The queues of reviewers: triage, alerts, disputed, adjudicated, all."""
    kinds = {
        "triage": needs_triage(now),
        "alerts": (F.col("priority") >= alert) & (F.col("status") != "rejected"),
        "disputed": F.col("status") == "disputed",
        "adjudicated": F.col("decision").isNotNull(),
        "all": F.lit(True),
    }
    return events.where(kinds[kind])


def routes(events: DataFrame, alert: int = ALERT_PRIORITY) -> DataFrame:
    """Appends the sinks of an event: enriched, and alerts and triage where it belongs there."""
    dead = F.coalesce("fatalities", F.lit(0))
    doubtful = (F.col("priority") >= 45) & (F.col("confidence") < 0.55)
    triage = F.col("decision").isNull() & ((F.col("status") == "disputed") | doubtful | ((F.col("independent_sources") == 1) & (dead >= 5)))
    sinks = F.array(
        F.lit("enriched"),
        F.when((F.col("priority") >= alert) & (F.col("status") != "rejected"), "alerts"),
        F.when(triage, "triage"),
    )
    return events.withColumn("sinks", F.array_compact(sinks))


def cap_by_priority(events: DataFrame, most: int) -> DataFrame:
    """All decided events, and of the others the most urgent so many. A top-k: a limit is the feature."""
    ranked = events.where("decision is null").orderBy(F.col("priority").desc(), F.col("event_id")).limit(most)
    return events.where("decision is not null").unionByName(ranked)


def newest(events: DataFrame, most: int) -> DataFrame:
    """The active set: the newest so many."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id")).limit(most)


def highlights(events: DataFrame, least: float = 0.45, most: int = 6) -> DataFrame:
    return events.where(F.col("confidence") >= least).orderBy(F.col("priority").desc(), F.col("event_id")).limit(most)


def not_seen(reports: DataFrame, seen: DataFrame, key: str = "source_id") -> DataFrame:
    """Reports whose key was not taken in before."""
    return reports.join(seen.select(key), key, "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
