"""Typed events of the feeds as raw reports, so that extraction, classification and fusion read them like any other.

A report has the columns that ``operators.extract.normalise`` reads, and topic, frp and brightness. Sensors and indexes
state a position; how wide it is depends on the feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Topics, and kilometres around a stated position.
NEWS, SENSORS = "raw.news", "raw.sensors"
CONFLICT_KM, THERMAL_KM, DRONE_KM = 5.0, 0.4, 0.5
NOWHERE = "localité non précisée"


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after its point, as text; null stays null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))


def _filled(x: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(x, F.lit(""))


def _report(events: DataFrame, kind: str, topic: str, source_id: Column, text: Column, at: Column, km: float, frp: Column | None = None, brightness: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    figure = lambda x: F.lit(None).cast("double") if x is None else F.coalesce(x.cast("double"), F.lit(0.0))
    return events.select(
        source_id.alias("source_id"), F.lit(kind).alias("source_type"), none.alias("handle"), none.alias("url"), text.alias("text"), at.alias("created_at"), F.lit("fr").alias("lang"),
        F.col("lat").alias("geo_lat"), F.col("lon").alias("geo_lon"), F.lit(km).alias("geo_radius_km"), F.lit(topic).alias("topic"), figure(frp).alias("frp"), figure(brightness).alias("brightness"),
    )


def conflict_reports(events: DataFrame) -> DataFrame:
    """Reports of ``landed.conflict_events``: the notes, or a sentence made of type, place and actors; then deaths and
    place where they are stated. A day without an hour is its noon; a record without a day has no time."""
    actors = F.array_join(F.array_compact(F.array(_filled(F.col("actor1")), _filled(F.col("actor2")))), " et ")
    made = F.concat(
        F.coalesce(_filled(F.col("subtype")), F.col("type")), F.lit(" signalé à "), F.coalesce(_filled(F.col("location")), F.lit(NOWHERE)),
        F.when(actors != "", F.concat(F.lit(" impliquant "), actors)).otherwise(""), F.lit("."),
    )
    dead = F.when(F.col("fatalities") > 0, F.concat(F.col("fatalities").cast("string"), F.lit(" morts rapportés.")))
    place = F.when(F.col("location") != "", F.concat(F.lit("Localité : "), "location", F.lit(", "), F.coalesce("admin1", F.lit("")), F.lit(".")))
    text = F.array_join(F.array_compact(F.array(F.coalesce(_filled(F.trim("notes")), made), dead, place)), " ")
    name = F.concat_ws(":", F.lit("acled"), F.coalesce("date", F.lit("")), _fixed(F.col("lat"), 3), _fixed(F.col("lon"), 3), F.col("type"))
    at = F.try_to_timestamp(F.concat("date", F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return _report(events, "acled", NEWS, name, text, at, CONFLICT_KM)


def thermal_reports(points: DataFrame) -> DataFrame:
    """Reports of ``landed.thermal_points``. Figures that a point lacks are question marks in its text, and 0 as numbers."""
    shown = lambda c, digits: F.coalesce(_fixed(F.col(c), digits), F.lit("?"))
    text = F.concat(
        F.lit("Anomalie thermique VIIRS détectée. Puissance radiative "), shown("frp", 1), F.lit(" MW, luminosité "), shown("brightness", 0), F.lit(" K, confiance capteur "),
        F.coalesce(_filled(F.col("confidence")), F.lit("n/a")), F.lit("."),
    )
    name = F.concat_ws(":", F.lit("firms"), F.coalesce("date", F.lit("")), F.coalesce(F.date_format("ts", "HHmm"), F.lit("")), _fixed(F.col("lat"), 4), _fixed(F.col("lon"), 4))
    return _report(points, "firms", SENSORS, name, text, F.col("ts"), THERMAL_KM, F.col("frp"), F.col("brightness"))


def drone_reports(sightings: DataFrame) -> DataFrame:
    """Reports of sightings (id, type, desc, platform, status, lat, lon, ts)."""
    or_ = lambda c, other: F.coalesce(F.col(c), other)
    text = F.concat(or_("desc", F.col("type")), F.lit(". Plateforme "), or_("platform", F.lit("UAS")), F.lit(", statut "), or_("status", F.lit("n/a")), F.lit("."))
    name = F.concat(F.lit("uas:"), F.coalesce(F.col("id").cast("string"), F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))))
    return _report(sightings, "uas_isr", SENSORS, name, text, F.col("ts"), DRONE_KM)
