"""Parsers of landed feeds into report-shaped rows, and their assembly.

A payload is a row with a JSON or XML text; rows that lack what cites them are dropped, nothing else fails a read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.text import host_of, strip_html, strip_links, tidy_title
from ..functions.times import compact_time, feed_time
from ..operators.feed import first_of, hours_before

ARTICLES = "articles array<struct<url string, title string, seendate string, domain string, language string>>"
YEARLY = "items array<struct<year int, total string>>"
POINTS = "events array<struct<id string, title string, closed string, categories array<struct<id string, title string>>, geometry array<struct<magnitudeValue double, date string, type string, coordinates array<double>>>>>"
FLOOD = "latitude double, longitude double, daily struct<time array<string>, river_discharge array<double>>"
FUNDING = "total double, donors array<struct<name string, funding double>>, plans array<struct<id long, name string, years array<string>, required double>>"
ALERTS = "data array<struct<datasource string, time long, level string, condition string, value double, historyValue double>>"
SCENES = "features array<struct<id string, bbox array<double>, properties struct<datetime string, `eo:cloud_cover` double, platform string>>>"
POSTS = "data array<struct<id string, text string, author_id string, created_at string, lang string>>, includes struct<users array<struct<id string, username string, verified boolean>>>"


def number(s: Column) -> Column:
    """A number from text; null for a dash, a blank or junk."""
    return F.nullif(F.trim(s), F.lit("-")).try_cast("double")


def articles(raw: DataFrame) -> DataFrame:
    """url, title, ts, domain, language of a news index: citable and dated ones, the first of a domain and title."""
    rows = raw.select(F.inline(F.from_json("payload", ARTICLES)["articles"])).withColumns({"title": tidy_title(F.col("title")), "ts": compact_time(F.col("seendate"))})
    rows = rows.where(F.regexp_like("url", F.lit("(?i)^https?://")) & (F.col("title") != "") & F.col("ts").isNotNull())
    return first_of(rows.withColumn("_t", F.lower("title")), ["domain", "_t"], [F.col("ts"), F.col("url")]).drop("_t", "seendate")


def feed_items(raw: DataFrame) -> DataFrame:
    """title, url, ts, summary of RSS items and Atom entries (payload: the XML)."""
    item = F.explode(F.regexp_extract_all("payload", F.lit(r"(?is)<(item|entry)\b.*?</\1>"), 0))
    tag = lambda names: F.coalesce(*[F.nullif(F.regexp_extract("item", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), F.lit("")) for n in names])
    href = F.nullif(F.regexp_extract("item", r"(?is)<link\b[^>]*href=[\"']([^\"']+)", 1), F.lit(""))
    rows = raw.select(item.alias("item")).select(
        strip_html(tag(["title"])).alias("title"), F.trim(F.coalesce(strip_html(F.nullif(tag(["link"]), F.lit(""))), F.lit(""))).alias("link"), href.alias("href"),
        feed_time(F.trim(tag(["pubDate", "published", "updated", "dc:date"]))).alias("ts"), strip_html(tag(["description", "summary", "content"])).alias("summary"),
    )
    return rows.select("title", F.coalesce(F.nullif("link", F.lit("")), "href").alias("url"), "ts", "summary").where("title <> '' and url is not null")


def posts(raw: DataFrame) -> DataFrame:
    """Posts with their authors: source_id, handle, source_type, text, ts, lang."""
    p = raw.select(F.from_json("payload", POSTS).alias("x"))
    users = p.select(F.inline("x.includes.users")).withColumnRenamed("id", "author_id").distinct()
    rows = p.select(F.inline("x.data")).join(users, "author_id", "left")
    return rows.select(
        F.concat(F.lit("post:"), "id").alias("source_id"), F.concat(F.lit("@"), "username").alias("handle"),
        F.when(F.coalesce("verified", F.lit(False)), "social_verified").otherwise("social_unverified").alias("source_type"),
        strip_links(F.col("text")).alias("text"), feed_time(F.col("created_at")).alias("ts"), "lang",
    )


def yearly(raw: DataFrame, name: str) -> DataFrame:
    """year and a total, of a yearly series."""
    return raw.select(F.inline(F.from_json("payload", YEARLY)["items"])).groupBy("year").agg(F.sum(number(F.col("total"))).alias(name))


def merge_years(*series: DataFrame) -> DataFrame:
    """A full outer merge by year, in order."""
    out = series[0]
    for s in series[1:]:
        out = out.join(s, "year", "full_outer")
    return out.orderBy("year")


def latest_points(raw: DataFrame) -> DataFrame:
    """id, title, category, lat, lon, ts of natural events, at the last point of each."""
    rows = raw.select(F.inline(F.from_json("payload", POINTS)["events"]))
    last = F.try_element_at(F.filter("geometry", lambda g: g["type"] == "Point"), F.lit(-1))
    return rows.withColumn("g", last).where("g is not null").select(
        "id", "title", F.get("categories", F.lit(0))["title"].alias("category"), F.col("g.coordinates")[1].alias("lat"), F.col("g.coordinates")[0].alias("lon"),
        F.to_timestamp("g.date").cast("timestamp_ntz").alias("ts"), F.col("closed").isNotNull().alias("closed"),
    )


def discharge(raw: DataFrame, today: str) -> DataFrame:
    """lat, lon, value today, ratio to the mean of the seven days before, forecast peak and its day."""
    x = raw.select(F.from_json("payload", FLOOD).alias("f")).select("f.latitude", "f.longitude", F.arrays_zip(F.col("f.daily.time").alias("day"), F.col("f.daily.river_discharge").alias("v")).alias("s"))
    before = F.slice(F.filter("s", lambda p: p["day"] < today), -7, 7)
    known = F.filter(F.transform(F.when(F.size(F.filter("s", lambda p: p["day"] < today)) >= 7, before).otherwise(F.filter("s", lambda p: p["day"] < today)), lambda p: p["v"]), lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(known), F.lit(0))
    now = F.try_element_at(F.filter("s", lambda p: p["day"] == today), F.lit(1))["v"]
    peak = F.array_max(F.transform(F.filter("s", lambda p: (p["day"] >= today) & p["v"].isNotNull()), lambda p: F.struct(p["v"].alias("v"), p["day"].alias("day"))))
    return x.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), now.alias("now"), (now / F.nullif(mean, F.lit(0.0))).alias("ratio"), peak["v"].alias("peak"), peak["day"].alias("peak_day"))


def connectivity(raw: DataFrame, now: datetime, recent_h: int = 24) -> DataFrame:
    """One row: worst level of recent alerts, and the number of sources that now report trouble."""
    a = raw.select(F.inline(F.from_json("payload", ALERTS)["data"])).withColumn("ts", F.timestamp_seconds("time").cast("timestamp_ntz"))
    last = a.groupBy("datasource").agg(F.max(F.struct("ts", "level")).alias("m")).select("datasource", "m.*")
    bad = (F.col("ts") >= hours_before(now, recent_h)) & (F.col("level") != "normal")
    rank = F.when(F.col("level") == "critical", 2).when(F.col("level") == "warning", 1).otherwise(0)
    s = last.agg(F.coalesce(F.max(F.when(bad, rank)), F.lit(0)).alias("r"), F.count_if(bad).alias("troubled"), F.count(F.lit(1)).alias("sources"))
    return s.select(F.when(F.col("sources") == 0, "unknown").when(F.col("r") == 2, "outage").when(F.col("r") == 1, "degraded").otherwise("normal").alias("status"), "troubled", "sources")


def scenes(raw: DataFrame) -> DataFrame:
    """id, ts, cloud, platform of satellite scenes, the newest first."""
    rows = raw.select(F.inline(F.from_json("payload", SCENES)["features"]))
    return rows.select("id", feed_time(F.col("properties.datetime")).alias("ts"), F.col("properties.`eo:cloud_cover`").alias("cloud"), F.col("properties.platform").alias("platform")).orderBy(F.col("ts").desc(), "id")


def quakes_near(quakes: DataFrame, lat: float, lon: float, km: float, volcanoes: list[tuple[float, float]], near_km: float = 60, depth_km: float = 25) -> DataFrame:
    """Quakes (lat, lon, depth) in reach with km, and whether they are shallow and by a volcano."""
    out = quakes.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), lat, lon)).where(F.col("km") <= km)
    by = F.lit(False)
    for la, lo in volcanoes:
        by |= haversine_km(F.col("lat"), F.col("lon"), la, lo) < near_km
    return out.withColumn("volcanic", by & (F.col("depth") < depth_km))


def funding(raw: DataFrame, year: int, most: int = 8) -> DataFrame:
    """One row: total, the largest donors, the year's plan and how much of it is covered (null without a plan)."""
    x = raw.select(F.inline(F.array(F.from_json("payload", FUNDING))))
    plan = F.try_element_at(F.filter("plans", lambda p: F.array_contains(p["years"], str(year))), F.lit(1))
    top = F.slice(F.sort_array(F.transform("donors", lambda p: F.struct(p["funding"].alias("funding"), p["name"].alias("name"))), False), 1, most)
    return x.select("total", top.alias("donors"), plan["name"].alias("plan"), (F.col("total") / F.nullif(plan["required"], F.lit(0.0))).alias("coverage"))


def wire(lists: list[DataFrame], now: datetime, hours: float = 96, most: int = 500) -> DataFrame:
    """Lists of reports (source_id, ts, ...) as one: the first of each source_id (earlier lists win), recent ones, the
    newest so many."""
    out = None
    for i, rows in enumerate(lists):
        rows = rows.withColumn("_list", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy("source_id").orderBy("_list", "ts")
    first = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_list")
    return first.where(F.col("ts") >= hours_before(now, hours)).orderBy(F.col("ts").desc(), "source_id").limit(most)


def source_type(url: Column, rules: dict[str, str], default: str = "press_other") -> Column:
    """By the host: of rules (host suffix -> type), the first that fits."""
    host, out = host_of(url), F.lit(None).cast("string")
    for suffix, kind in rules.items():
        out = F.coalesce(out, F.when((host == suffix) | host.endswith(f".{suffix}"), kind))
    return F.coalesce(out, F.lit(default))
