"""Series over time: calendars, chunks, runs, trailing windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feed import active, age_hours, hours_before, timestamp
from .folds import run_lengths
from .tallies import incident, window_of


def daily_series(events: DataFrame, days: int, now: datetime) -> DataFrame:
    """day, total, conflict, humanitarian, political for each of the last days (UTC), quiet ones too."""
    start, end = window_of(now, days)
    spark = events.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(start.date()), F.lit(end.date()))).alias("day"))
    day = F.col("ts").cast("date")
    rows = active(events).where(incident()).where(F.col("ts") >= timestamp(start)).withColumn("day", day)
    n = lambda c: F.count_if(F.col("category") == c)
    counts = rows.groupBy("day").agg(F.count(F.lit(1)).alias("total"), *[n(c).alias(c) for c in ("conflict", "humanitarian", "political")])
    return calendar.join(F.broadcast(counts), "day", "left").na.fill(0).orderBy("day")  # at most ``days`` rows


def weekly_series(daily: DataFrame) -> DataFrame:
    """Sums of seven days, oldest first; the days before the first whole week are left out. ``daily``: day, total."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = daily.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1).withColumn("skip", n % 7)
    week = F.floor((F.col("i") - F.col("skip")) / 7)
    return rows.where("i >= skip").groupBy(week.alias("week")).agg(F.min("day").alias("start"), F.sum("total").alias("total")).drop("week").orderBy("start")


def sparkline_trend(events: DataFrame, now: datetime) -> DataFrame:
    """One row: counts of the last seven days, and the change of the last three against the first three in percent."""
    back = F.datediff(F.lit(now.date()), F.col("ts").cast("date"))
    counts = events.where(back.between(0, 6)).agg(*[F.count_if(back == i).alias(f"d{i}") for i in range(6, -1, -1)])
    first, last = F.col("d6") + F.col("d5") + F.col("d4"), F.col("d2") + F.col("d1") + F.col("d0")
    return counts.withColumn("trend_pct", (last - first) * 100.0 / F.greatest(first, F.lit(1)))


def trailing_sum(samples: DataFrame, key: str, now: datetime, hours: float, digits: int = 1) -> DataFrame:
    """Sum of the samples (key, ts, value) of the last hours, the future left out; null without samples."""
    inside = (F.col("ts") <= timestamp(now)) & (F.col("ts") >= hours_before(now, hours))
    total = F.sum(F.when(inside, F.coalesce("value", F.lit(0.0))))
    return samples.groupBy(key).agg(F.round(total, digits).alias("total"), F.count_if(inside).alias("n"))


def latest_as_of(samples: DataFrame, key: str, now: datetime) -> DataFrame:
    """The newest value of each key that is known and not in the future."""
    rows = samples.where((F.col("ts") <= timestamp(now)) & F.col("value").isNotNull())
    at = F.struct("ts", "value")
    return rows.groupBy(key).agg(F.max(at).alias("m")).select(key, F.col("m.ts").alias("ts"), F.col("m.value").alias("value"))


def runs(samples: DataFrame, key: str, hit: Column, order: list[str]) -> DataFrame:
    """Appends hit, and run: how many hits in a row end at this sample (0 where it is none). A long history is spread."""
    return run_lengths(samples.drop("hit"), [key], order, hit)


def outages(samples: DataFrame, key: str, order: list[str], least: int = 3) -> DataFrame:
    """The state of each key after its last sample: run length, and whether it is an outage (a run of drops).
    samples: key, order columns, hit (boolean), drop (boolean)."""
    rows = runs(samples.withColumnRenamed("hit", "_hit"), key, F.col("_hit"), order)
    last = F.struct(*order, "run", "drop")
    state = rows.groupBy(key).agg(F.max(last).alias("m"))
    return state.select(key, F.col("m.run").alias("run"), ((F.col("m.run") >= least) & F.col("m.drop")).alias("outage"))


def moving_ratio(series: DataFrame, key: str, order: str, days: int = 7) -> DataFrame:
    """Appends week_mean (of the days before) and ratio of the value to it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-days, -1)
    mean = F.avg("value").over(w)
    return series.withColumn("week_mean", mean).withColumn("ratio", F.col("value") / F.nullif(F.col("week_mean"), F.lit(0.0)))


def last_of(samples: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The history kept for each key: its newest so many samples."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def decayed(observations: DataFrame, keys: list[str], now: datetime, half_life_days: float = 90.0) -> DataFrame:
    """alpha, beta and n: weights of right and wrong observations, halved every so many days."""
    age = F.greatest(F.lit(0.0), age_hours(F.col("at"), now) / 24)
    w = F.col("weight") * F.pow(F.lit(0.5), age / half_life_days)
    return observations.groupBy(*keys).agg(
        F.sum(F.when(F.col("correct"), w).otherwise(0.0)).alias("alpha"), F.sum(F.when(~F.col("correct"), w).otherwise(0.0)).alias("beta"), F.sum(w).alias("n")
    )
