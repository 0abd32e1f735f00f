"""Reports: their review as a log, gaps of a period, events that bear on a question, and briefs of evidence records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, unmark
from ..storage import cut
from .feed import active, age_hours, highlights, hours_before, timestamp
from .folds import run_lengths
from .records import retrieve, scored
from .tallies import actor_activity, period_counts, periods, silent, trend_lines, upper_median_lag

#: A level that writes but does not review.
WRITER = "analyst"
#: Weights of a term that an event's place, actors, and type or description contain.
PLACE, ACTOR, WHAT = 3, 3, 1
_LEVELS = ["low", "medium", "high"]


def review_log(log: DataFrame) -> DataFrame:
    """``log`` with version, took_effect and state (after the row: draft, in_review, approved).

    ``log``: report_id, seq (their order), action (create, version, submit, approve, return; others are kept without
    effect), actor, level, note. A create or version makes a draft, whatever was before. A draft can be submitted. In
    review, a second person who is not a mere writer may approve it, or return it with a note, which makes it a draft
    again; the author of the version may do neither. Rows before the first version have version 0, no effect and a null
    state. All follows from windows over a report's rows: no list of them is built.
    """
    upto = Window.partitionBy("report_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    within = Window.partitionBy("report_id", "version").orderBy("seq")
    so_far, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    edit = F.col("action").isin("create", "version")
    rows = log.withColumn("version", F.sum(F.when(edit, 1).otherwise(0)).over(upto).cast("int"))
    rows = rows.withColumn("_author", F.first("actor").over(so_far))
    second = F.coalesce(F.col("level") != WRITER, F.lit(False)) & ~F.col("actor").eqNullSafe(F.col("_author"))
    stated = F.trim(F.coalesce("note", F.lit(""))) != ""
    # Until an approval takes effect, the last submission or allowed return decides whether the version is in review.
    step = F.when(F.col("action") == "submit", "in_review").when((F.col("action") == "return") & second & stated, "draft")
    rows = rows.withColumn("_step", step).withColumn("_was", F.coalesce(F.last("_step", ignorenulls=True).over(before), F.lit("draft")))
    rows = rows.withColumn("_may", (F.col("action") == "approve") & second & (F.col("_was") == "in_review") & (F.col("version") > 0))
    rows = rows.withColumn("_done", F.coalesce(F.max("_may").over(before), F.lit(False)))
    moved = F.col("_may") | (F.col("_step").isNotNull() & (F.col("_step") != F.col("_was")))
    effect = F.coalesce(edit | ((F.col("version") > 0) & ~F.col("_done") & moved), F.lit(False))
    state = F.when(F.col("_done") | F.col("_may"), "approved").otherwise(F.coalesce("_step", "_was"))
    return rows.withColumn("took_effect", effect).withColumn("state", F.when(F.col("version") > 0, state)).drop("_author", "_step", "_was", "_may", "_done")


def review_states(log: DataFrame) -> DataFrame:
    """report_id, versions, state, author (of the last version), reviewer (of a standing approval) of every report."""
    rows = review_log(log)
    edit, approved = F.col("action").isin("create", "version"), (F.col("action") == "approve") & F.col("took_effect")
    out = rows.groupBy("report_id").agg(
        F.max("version").alias("versions"), F.max_by("state", "seq").alias("state"), F.max_by(F.when(edit, F.col("actor")), F.when(edit, F.col("seq"))).alias("author"),
        F.max_by(F.when(approved, F.col("actor")), F.when(approved, F.col("seq"))).alias("reviewer"),
    )
    return out.withColumn("reviewer", F.when(F.col("state") == "approved", F.col("reviewer")))


def gaps(events: DataFrame, now: datetime, hours: float = 24, key: str = "territory", named: int = 6, slow_h: float = 6) -> DataFrame:
    """gap, n, detail: what a period's picture lacks. single_family, unlocated, disputed: events; silent: keys with events
    in 30 days but none now, of which detail names the first by name; slow: events, if the upper median of hours to
    ingestion is above ``slow_h``. A gap that does not exist has no row."""
    cur, _ = periods(now, hours)
    counts = active(events).where(cur).agg(
        F.count_if(F.col("independent_sources") <= 1).alias("single_family"), F.count_if(F.col("lat").isNull()).alias("unlocated"),
        F.count_if(F.col("status") == "disputed").alias("disputed"), F.count(F.lit(1)).alias("total"),
    )
    plain = F.array(*[F.struct(F.lit(g).alias("gap"), F.col(g).alias("n"), F.concat(F.lit("of "), F.col("total")).alias("detail")) for g in ("single_family", "unlocated", "disputed")])
    quiet = silent(events, key, now, hours)
    names = quiet.orderBy(key).limit(named).agg(F.array_join(F.array_sort(F.collect_list(key)), ", ").alias("detail"))  # a few names
    quiet_row = quiet.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(names)).select(F.lit("silent").alias("gap"), "n", "detail")
    lag = upper_median_lag(events, now, hours).where(F.col("lag_hours") > slow_h)
    slow = lag.select(F.lit("slow").alias("gap"), "n", F.format_string("%.1f h", "lag_hours").alias("detail"))
    return counts.select(F.inline(plain)).unionByName(quiet_row).unionByName(slow).where("n > 0")


def related_events(events: DataFrame, question: str, now: datetime, most: int = 5) -> DataFrame:
    """event_id, score, and of all matching events total, recent (up to 7 days old), previous (up to 14): the best
    matches of a question's terms, the newest first among equals. A top-k: a limit is the feature."""
    fields = {
        "_place": (F.concat_ws(" ", "place", "province", "territory"), PLACE),
        "_actor": (F.array_join("actors", " "), ACTOR),
        "_what": (F.concat_ws(" ", "event_type", "description"), WHAT),
    }
    hits = cut(scored(active(events), question, fields).select("event_id", "ts", "score").where("score > 0"))
    days = age_hours(F.col("ts"), now) / 24
    counts = hits.agg(F.count(F.lit(1)).alias("total"), F.count_if(days <= 7).alias("recent"), F.count_if((days > 7) & (days <= 14)).alias("previous"))  # one row
    best = hits.orderBy(F.col("score").desc(), F.col("ts").desc(), "event_id").limit(most)
    return best.select("event_id", "score").crossJoin(F.broadcast(counts))


def brief(records: DataFrame, question: str, most: int = 6) -> DataFrame:
    """One row on what the best records say to a question: found, usable, verified, disputed, unsourced, illustrative
    (numbers), level, findings (ids, the best first), missed (terms), unresolved (ids), steps.

    ``records``: as ``retrieve`` takes them, and status, confidence, sources (their number), illustrative. Usable are
    records with a source that are not illustrative; the level is that of the least sure of them, and high only if one
    record is verified; without usable ones it is none."""
    hits = retrieve(records, question, most)
    sourced = F.col("sources") > 0
    usable = sourced & ~F.col("illustrative")
    rank = F.when(usable, F.array_position(F.array(*map(F.lit, _LEVELS)), F.col("confidence")))
    hay = unmark(F.concat_ws(" ", "title", F.array_join("entities", " "), "meta", "body"))
    order = F.struct((-F.col("score")).alias("s"), (-F.col("updated_at")).alias("u"), "id")
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, order))), lambda o: o["id"])  # noqa: E731  (of a few rows)
    out = hits.agg(
        F.count(F.lit(1)).alias("found"), F.count_if(usable).alias("usable"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "disputed").alias("disputed"),
        F.count_if(~sourced).alias("unsourced"), F.count_if("illustrative").alias("illustrative"), F.min(rank).alias("rank"), F.count_if(F.col("sources") == 1).alias("single"),
        F.count_if(F.col("status") == "draft").alias("drafts"), ids(F.lit(True)).alias("findings"), ids(F.col("status").isin("disputed", "draft")).alias("unresolved"),
        F.collect_list(hay).alias("hay"),
    )
    level = F.when(F.col("rank").isNull(), "none").when((F.col("rank") == 3) & (F.col("verified") == 0), "medium").otherwise(F.try_element_at(F.array(*map(F.lit, _LEVELS)), F.col("rank").cast("int")))
    missed = F.filter(query_terms(F.lit(question)), lambda t: ~F.exists("hay", lambda h: F.contains(h, t)))
    checks = {"open_record": F.col("found") == 0, "add_sources": F.col("unsourced") > 0, "second_source": F.col("single") > 0, "settle_dispute": F.col("disputed") > 0, "submit_drafts": F.col("drafts") > 0, "approve_brief": F.col("found") > 0}
    steps = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return out.select("found", "usable", "verified", "disputed", "unsourced", "illustrative", level.alias("level"), "findings", missed.alias("missed"), "unresolved", steps.alias("steps"))


# States of a region's connectivity.
DEGRADED, WATCHED, NOMINAL = "DÉGRADÉ", "SURVEILLÉ", "NOMINAL"


def connectivity(samples: DataFrame, key: str, order: list[str], least: int = 3) -> DataFrame:
    """``key``, status, run, drop: how each key stands after its last sample (``key``, ``order``, hit, drop). Degraded after
    so many hits in a row of which the last is a drop, watched after any hit ever, else nominal. ``run`` counts the hits at
    the end, ``drop`` tells of the last hit (null without one)."""
    rows = run_lengths(samples.select(key, *order, F.coalesce("hit", F.lit(False)).alias("_hit"), "drop"), [key], order, F.col("_hit"))
    at = F.struct(*order)
    ends = rows.groupBy(key).agg(F.max_by("run", at).alias("run"), F.max_by("drop", F.when(F.col("hit"), at)).alias("drop"), F.count_if("hit").alias("_hits"))
    state = F.when((F.col("run") >= least) & F.col("drop"), DEGRADED).when(F.col("_hits") > 0, WATCHED).otherwise(NOMINAL)
    return ends.select(key, state.alias("status"), "run", "drop")


def _listed(rows: DataFrame, name: str, order: list[Column], *columns: str) -> DataFrame:
    """One row: an array of the rows' columns as structs, in an order that their values settle."""
    first = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.struct(*columns).alias("x"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["x"]).alias(name))


def sitrep(
    events: DataFrame, now: datetime, hours: float = 24, province: str | None = None, monitors: DataFrame | None = None,
    clusters: DataFrame | None = None, least: float = 0.45, gap_key: str = "territory",
) -> DataFrame:
    """A situation report as one row: province, period_start, period_end; the columns of ``tallies.period_counts``; and
    arrays of structs: highlights (event_id, priority, confidence), trends, actors, gaps, connectivity (from ``monitors``:
    province, status, run, drop) and clusters (as ``anomaly.scan`` gives them), each in its own order; empty where there
    is nothing. A province (null: all) restricts events and monitors. A list is as long as there are types and places,
    never as events, so the row stays small whatever their number."""
    rows = events if province is None else events.where(F.col("province") == province)
    cur, _ = periods(now, hours)
    best = highlights(active(rows).where(cur), least)
    change = -F.abs(F.col("current") - F.col("previous"))
    parts = [
        _listed(best, "highlights", [-F.col("priority"), F.col("event_id")], "event_id", "priority", "confidence"),
        _listed(trend_lines(rows, now, hours), "trends", [~F.col("significant"), change, F.col("kind"), F.col("label")], "kind", "label", "current", "previous", "delta_pct", "significant", "direction"),
        _listed(actor_activity(rows, now, hours), "actors", [-F.col("current"), F.col("actor")], "actor", "current", "previous", "delta_pct"),
        _listed(gaps(rows, now, hours, gap_key), "gaps", [F.col("gap")], "gap", "n", "detail"),
    ]
    if monitors is not None:
        own = monitors if province is None else monitors.where(F.col("province") == province)
        parts.append(_listed(own, "connectivity", [F.col("province")], "province", "status", "run", "drop"))
    if clusters is not None:
        parts.append(_listed(clusters, "clusters", [-F.col("llr"), F.col("centre"), F.col("radius_km"), F.col("hours")], *clusters.columns))
    out = period_counts(rows, now, hours)
    for p in parts:
        out = out.crossJoin(F.broadcast(p))  # one row each
    head = [F.lit(province).cast("string").alias("province"), hours_before(now, hours).alias("period_start"), timestamp(now).alias("period_end")]
    return out.select(*head, "*")
