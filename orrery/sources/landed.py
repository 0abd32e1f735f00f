"""Parsers of landed payloads of conflict, thermal, relief, outbreak, displacement, funding and aircraft feeds, and the
reports that typed events make. ``raw`` has a row a payload (column payload); a payload that does not parse, or lacks
its list, gives no rows. What a feed leaves out is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_html
from ..functions.times import feed_time
from .feeds import number

_TEXTS = ("event_type", "sub_event_type", "event_date", "location", "admin1", "latitude", "longitude", "fatalities", "actor1", "actor2", "notes")
CONFLICT = "success boolean, data array<struct<" + ", ".join(f"{c} string" for c in _TEXTS) + ">>"
RELIEF = (
    "data array<struct<id string, fields struct<title string, body string, url string, `date` struct<created string, original string>,"
    " source array<struct<name string, shortname string>>, theme array<struct<name string>>>>>"
)
OUTBREAKS = "value array<struct<PublicationDate string, Summary string, Title string, OverrideTitle string, DonId string>>"
POPULATION = "items array<struct<year string, refugees string, asylum_seekers string, idps string, returned_idps string, total string>>"
FUNDS = "data struct<report1 struct<fundingTotals struct<total double, objects array<struct<singleFundingObjects array<struct<name string, totalFunding double>>>>>>>"
PLANS = "data array<struct<id long, planVersion struct<name string>, years array<struct<year string>>, origRequirements double, revisedRequirements double>>"
STATES = "states array<array<string>>"
#: Characters of a relief body that are kept; donors that are listed.
BODY, DONORS = 1500, 8
# Organisations whose reports come from the field.
FIELD = "msf|nrc|oxfam|caritas|save the children|irc|acted|solidarit|medair|world vision|unicef|wfp|unhcr|iom|oim"


def conflict_events(raw: DataFrame) -> DataFrame:
    """src, type, subtype, date, location, admin1, lat, lon, fatalities, actor1, actor2, notes of a conflict index."""
    e = raw.select(F.from_json("payload", CONFLICT).alias("p")).where("p.success").select(F.inline("p.data"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return e.select(
        F.lit("acled").alias("src"), text("event_type").alias("type"), text("sub_event_type").alias("subtype"), text("event_date").alias("date"), text("location").alias("location"),
        text("admin1").alias("admin1"), number(F.col("latitude")).alias("lat"), number(F.col("longitude")).alias("lon"), number(F.col("fatalities")).cast("long").alias("fatalities"),
        text("actor1").alias("actor1"), text("actor2").alias("actor2"), text("notes").alias("notes"),
    )


def thermal_points(raw: DataFrame) -> DataFrame:
    """date, ts, lat, lon, brightness, frp, confidence, daynight of CSV payloads, by the names in their first line; one
    without a latitude column is some error page, and gives no rows."""
    lines = raw.select(F.split(F.regexp_replace("payload", "\r", ""), "\n").alias("l")).where(F.contains(F.get("l", F.lit(0)), F.lit("latitude")))
    each = lines.select(F.split(F.get("l", F.lit(0)), ",").alias("h"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("line")).where("line <> ''")
    row = each.select("h", F.split("line", ",").alias("v"))
    at = lambda name: F.when(F.array_position("h", F.lit(name)) > 0, F.get("v", F.array_position("h", F.lit(name)).cast("int") - 1))
    hhmm = F.lpad(F.coalesce(at("acq_time"), F.lit("0")), 4, "0")
    ts = F.try_to_timestamp(F.concat_ws(" ", at("acq_date"), hhmm), F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz")
    return row.select(
        at("acq_date").alias("date"), ts.alias("ts"), *[number(at(c)).alias(n) for c, n in (("latitude", "lat"), ("longitude", "lon"), ("bright_ti4", "brightness"), ("frp", "frp"))],
        at("confidence").alias("confidence"), at("daynight").alias("daynight"),
    )


def publisher_type(name: Column) -> Column:
    """The source type of a publishing organisation."""
    o = F.lower(name)
    mission = F.contains(o, F.lit("monusco")) | F.contains(o, F.lit("monuc"))
    return F.when(F.contains(o, F.lit("ocha")), "ocha").when(mission, "monusco").when(F.regexp_like(o, F.lit(FIELD)), "ngo_field").otherwise("reliefweb")


def relief_reports(raw: DataFrame) -> DataFrame:
    """source_type, source_id, handle, url, text, created_at, lang of relief reports: title and the start of the body."""
    d = raw.select(F.inline(F.from_json("payload", RELIEF)["data"]))
    first, title = F.get("fields.source", F.lit(0)), F.coalesce("fields.title", F.lit(""))
    body = F.substring(F.regexp_replace(F.coalesce("fields.body", F.lit("")), r"\s+", " "), 1, BODY)
    handle = F.coalesce(F.nullif(first["shortname"], F.lit("")), F.nullif(first["name"], F.lit("")), F.lit("ReliefWeb"))
    english = F.regexp_like(title, F.lit(r"(?i)\b(the|and|of|in|with|reported)\b"))
    return d.select(
        publisher_type(handle).alias("source_type"), F.concat(F.lit("reliefweb:"), "id").alias("source_id"), handle.alias("handle"), F.col("fields.url").alias("url"),
        F.trim(F.concat(title, F.lit(". "), body)).alias("text"), feed_time(F.coalesce("fields.date.created", "fields.date.original")).alias("created_at"), F.when(english, "en").otherwise("fr").alias("lang"),
    )


def outbreak_notices(raw: DataFrame) -> DataFrame:
    """id, title, published, summary of outbreak notices that have an id and a day."""
    v = raw.select(F.inline(F.from_json("payload", OUTBREAKS)["value"])).where("DonId <> '' and PublicationDate <> ''")
    title = F.trim(F.coalesce(F.nullif("OverrideTitle", F.lit("")), "Title", F.lit("")))
    return v.select(F.col("DonId").alias("id"), title.alias("title"), feed_time(F.col("PublicationDate")).alias("published"), strip_html(F.col("Summary")).alias("summary"))


def displacement(origin: DataFrame, asylum: DataFrame, idmc: DataFrame) -> DataFrame:
    """year and six figures of it, from three yearly series; a year that one of them lacks keeps the others' figures. Of
    rows of one year the last of a payload counts."""

    def series(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
        x = raw.select(F.posexplode(F.from_json("payload", POPULATION)["items"]).alias("i", "x")).withColumn("year", number(F.col("x.year")).cast("int")).where("year is not null")
        return x.groupBy("year").agg(*[F.max_by(F.struct(number(F.col(f"x.{c}")).cast("long").alias("v")), "i")["v"].alias(n) for c, n in columns.items()])

    own = {"refugees": "refugees_abroad", "asylum_seekers": "asylum_seekers_abroad", "idps": "idps_unhcr", "returned_idps": "returned_idps"}
    out = series(origin, own).join(series(asylum, {"refugees": "refugees_hosted"}), "year", "full_outer")
    return out.join(series(idmc, {"total": "idps_idmc"}), "year", "full_outer")


def funding(flows: DataFrame, plans: DataFrame, year: int) -> DataFrame:
    """donor, funding, rank of the largest donors, with the total, and the year's plan: plan, required, coverage (null
    where nothing is required)."""
    t = flows.select(F.from_json("payload", FUNDS)["data"]["report1"]["fundingTotals"].alias("t")).where("t is not null")
    lists = F.coalesce(F.get("t.objects", F.lit(0))["singleFundingObjects"], F.array().cast("array<struct<name: string, totalFunding: double>>"))
    donors = t.select(F.col("t.total").alias("total"), F.slice(F.sort_array(F.transform(lists, lambda d: F.struct((-d["totalFunding"]).alias("f"), d["name"].alias("donor")))), 1, DONORS).alias("d"))
    p = plans.select(F.inline(F.from_json("payload", PLANS)["data"])).where(F.exists("years", lambda y: y["year"] == str(year)))
    one = p.select(F.col("planVersion.name").alias("plan"), F.coalesce("revisedRequirements", "origRequirements").alias("required"), "id").orderBy("id").limit(1)  # a year's plan
    rows = donors.select("total", F.posexplode("d").alias("at", "x")).select("total", F.col("x.donor").alias("donor"), (-F.col("x.f")).alias("funding"), (F.col("at") + 1).alias("rank"))
    return rows.join(F.broadcast(one.drop("id")), F.lit(True), "left").withColumn("coverage", F.col("total") / F.nullif("required", F.lit(0.0)))  # one plan


def aircraft(raw: DataFrame) -> DataFrame:
    """icao, callsign, country, lon, lat, alt, on_ground, velocity, heading of state vectors, those with a position."""
    s = raw.select(F.explode(F.from_json("payload", STATES)["states"]).alias("s"))
    at = lambda i: F.get("s", F.lit(i))
    out = s.select(
        at(0).alias("icao"), F.trim(F.coalesce(at(1), F.lit(""))).alias("callsign"), at(2).alias("country"), number(at(5)).alias("lon"), number(at(6)).alias("lat"),
        number(at(7)).alias("alt"), (at(8) == "true").alias("on_ground"), number(at(9)).alias("velocity"), number(at(10)).alias("heading"),
    )
    return out.where("lon is not null and lat is not null")


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)
