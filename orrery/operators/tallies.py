"""Counts, indicators and comparisons of periods: conditional aggregation in one pass over the events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import mercator_px
from ..functions.stats import percent_change, poisson_significant
from .feed import RANGES, active, hours_before, timestamp

CLUSTER_MAX_ZOOM = 9.5


def dead() -> Column:
    return F.coalesce("fatalities", F.lit(0))


def backed() -> Column:
    return F.col("status").isin("confirmed", "corroborated")


def incident() -> Column:
    return ~F.col("category").isin("sensor", "other")


def tally_by(events: DataFrame, key: Column) -> DataFrame:
    """key, count, fatalities, confirmed; blank keys are left out. The largest first."""
    rows = events.withColumn("key", key).where(F.col("key").isNotNull() & (F.col("key") != ""))
    return (
        rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("count"), F.sum(dead()).cast("long").alias("fatalities"), F.count_if(backed()).alias("confirmed"))
        .orderBy(F.col("count").desc(), "key")
    )


def situation(events: DataFrame, named: str, now: datetime) -> DataFrame:
    """One row of headline indicators of a range, and the change against the equal range before it."""
    hours = RANGES[named]
    inside = F.lit(True) if hours is None else F.col("ts") >= hours_before(now, hours)
    before = F.lit(False) if hours is None else (F.col("ts") >= hours_before(now, 2 * hours)) & ~inside
    n = lambda c: F.count_if(inside & c)
    rows = active(events).where(incident())
    sums = rows.agg(
        F.count_if(inside).alias("total"),
        *[n(F.col("category") == c).alias(c) for c in ("conflict", "humanitarian", "political")],
        n(backed()).alias("backed"),
        F.coalesce(F.sum(F.when(inside, dead())), F.lit(0)).cast("long").alias("fatalities"),
        F.coalesce(F.sum(F.when(inside, F.coalesce("displaced", F.lit(0)))), F.lit(0)).cast("long").alias("displaced"),
        n(F.col("origin") == "simulated").alias("simulated"),
        F.max(F.when(inside, F.col("updated_at"))).alias("freshest"),
        F.count_if(before).alias("before"),
    )
    share = F.col("backed") / F.nullif("total", F.lit(0))
    change = (F.col("total") - F.col("before")) * 100.0 / F.nullif("before", F.lit(0))
    return sums.withColumn("corroborated_share", share).withColumn("change_pct", change).drop("backed", "before")


def family_mix(reports: DataFrame) -> DataFrame:
    """family, reports, simulated over contributing reports (one row each); the largest first."""
    return (
        reports.groupBy("family")
        .agg(F.count(F.lit(1)).alias("reports"), F.count_if("simulated").alias("simulated"))
        .orderBy(F.col("reports").desc(), "family")
    )


def periods(now: datetime, hours: float) -> tuple[Column, Column]:
    """(in the current period, in the one before): [now - h, now), [now - 2h, now - h)."""
    ts, start = F.col("ts"), hours_before(now, hours)
    return (ts >= start) & (ts < timestamp(now)), (ts >= hours_before(now, 2 * hours)) & (ts < start)


def compared(rows: DataFrame, keys: list[str], now: datetime, hours: float, least: Column | int) -> DataFrame:
    """current, previous, delta_pct, significant, direction of each key with so many in both periods."""
    cur, prev = periods(now, hours)
    counted = rows.groupBy(*keys).agg(F.count_if(cur).alias("current"), F.count_if(prev).alias("previous"))
    c, p = F.col("current"), F.col("previous")
    return counted.where(c + p >= least).select(
        *keys, "current", "previous",
        percent_change(c, p).alias("delta_pct"),
        poisson_significant(c, p).alias("significant"),
        F.when(c > p, "up").when(c < p, "down").otherwise("flat").alias("direction"),
    )


def trend_lines(events: DataFrame, now: datetime, hours: float = 24) -> DataFrame:
    """By type (two events and more in both periods) and by territory, else province (three and more); significant
    ones first, then by the size of the change."""
    rows = active(events)
    by_type = F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("label"))
    by_place = F.struct(F.lit("place").alias("kind"), F.coalesce("territory", "province").alias("label"))
    both = rows.select("ts", F.inline(F.array(by_type, by_place)).alias("kind", "label")).where(F.col("label").isNotNull() & (F.col("label") != ""))
    out = compared(both, ["kind", "label"], now, hours, F.when(F.col("kind") == "type", 2).otherwise(3))
    return out.orderBy(F.col("significant").desc(), F.abs(F.col("current") - F.col("previous")).desc(), "kind", "label")


def actor_activity(events: DataFrame, now: datetime, hours: float = 24, most: int = 8) -> DataFrame:
    """Actors of two events and more in both periods, the busiest now first."""
    rows = active(events).select("ts", F.explode("actors").alias("actor"))
    out = compared(rows, ["actor"], now, hours, 2).drop("significant", "direction")
    return out.orderBy(F.col("current").desc(), "actor").limit(most)


def period_counts(events: DataFrame, now: datetime, hours: float = 24) -> DataFrame:
    """One row: events by status, and fatalities with their range, of the current period."""
    cur, _ = periods(now, hours)
    rows = active(events).where(cur)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "corroborated", "unverified", "disputed")],
        total(dead()).alias("fatalities"),
        total(F.coalesce("fatalities_low", "fatalities", F.lit(0))).alias("fatalities_low"),
        total(F.coalesce("fatalities_high", "fatalities", F.lit(0))).alias("fatalities_high"),
        total(F.coalesce("displaced", F.lit(0))).alias("displaced"),
    )


def silent(events: DataFrame, key: str, now: datetime, hours: float = 24, days: int = 30) -> DataFrame:
    """Keys with events in the last days, but none in the current period."""
    cur, _ = periods(now, hours)
    rows = active(events).where(F.col("ts") >= hours_before(now, days * 24)).where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.count_if(cur).alias("n")).where("n = 0").select(key)


def upper_median_lag(events: DataFrame, now: datetime, hours: float = 24) -> DataFrame:
    """Of hours from event to ingestion; of an even number, the upper of the middle two. Ranks come from counts of
    equal lags (whole minutes), not from a list of all."""
    cur, _ = periods(now, hours)
    lag = F.timestamp_diff("MINUTE", F.col("ts"), F.col("ingested_at"))
    counts = active(events).where(cur).select(lag.alias("lag")).where("lag >= 0").groupBy("lag").agg(F.count(F.lit(1)).alias("n"))
    up = counts.withColumn("upto", F.sum("n").over(Window.orderBy("lag"))).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return up.where(F.col("upto") > F.floor(F.col("total") / 2)).agg((F.min("lag") / 60.0).alias("lag_hours"), F.max("total").alias("n"))


def grid_clusters(points: DataFrame, zoom: float, cell_px: int = 52) -> DataFrame:
    """Points (event_id, lat, lon) binned by map pixel: mean position and size; every point alone when zoomed in."""
    if zoom >= CLUSTER_MAX_ZOOM:
        return points.select(F.col("lat"), F.col("lon"), F.lit(1).cast("long").alias("n"), F.col("event_id").alias("first_id"))
    x, y = mercator_px(F.col("lat"), F.col("lon"), zoom)
    return (
        points.groupBy(F.floor(x / cell_px).alias("cx"), F.floor(y / cell_px).alias("cy"))
        .agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
        .drop("cx", "cy")
    )


def dominant(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """The most frequent key of each group; of equally frequent ones the one that comes first."""
    counts = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(key, F.struct(F.col("n"), -F.col("first")))
    return counts.groupBy(group).agg(best.alias("dominant"), F.max("n").alias("n"))


def top_and_rest(rows: DataFrame, key: str, most: int = 4) -> DataFrame:
    """The most frequent keys and ``other``: count and share in percent."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), key)))  # one row a key
    label = F.when(F.col("rank") <= most, F.col(key)).otherwise("other")
    whole = F.sum("n").over(Window.partitionBy())
    return ranked.groupBy(label.alias("label")).agg(F.sum("n").alias("n")).withColumn("share", F.col("n") * 100.0 / whole)


def by_place_displaced(events: DataFrame) -> DataFrame:
    return events.where("displaced > 0").groupBy("province").agg(F.sum("displaced").cast("long").alias("displaced"))


def layer_counts(layers: dict[str, DataFrame | None], columns: str = "layer string, n long") -> DataFrame:
    """One row a layer; a layer that is not loaded counts null, an empty one 0."""
    found = [df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n")) for name, df in layers.items() if df is not None]
    spark = next(df for df in layers.values() if df is not None).sparkSession
    missing = [(name, None) for name, df in layers.items() if df is None]
    out = spark.createDataFrame(missing, columns)
    for df in found:
        out = out.unionByName(df)
    return out


def feed_health(feeds: DataFrame) -> DataFrame:
    """feeds: feed, health (ok, degraded, error, idle), error. Feeds that idle with an error do not count."""
    counted = feeds.where(~((F.col("health") == "idle") & F.col("error").isNotNull()))
    return counted.agg(F.count_if(F.col("health").isin("ok", "degraded")).alias("up"), F.count(F.lit(1)).alias("total"))


def window_of(now: datetime, days: int) -> tuple[datetime, datetime]:
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return day - timedelta(days=days - 1), day
