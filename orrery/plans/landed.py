"""Queries over landed payloads, which are written from the tables in the shapes of the feeds and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bridge, landed
from .adapter import ev, sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _payloads(rows, item, wrap):
    """A payload of each fifty ids: ``item`` is one record, ``wrap`` what holds the list of them."""
    return rows.groupBy(F.floor(F.col("event_id") / 50)).agg(F.to_json(wrap(F.collect_list(item))).alias("payload"))


@query(
    sql(
        """select 'acled' as src, event_type as type, category as subtype, strftime(ts, '%Y-%m-%d') as date, place as location, coalesce(territory, '') as admin1, lat, lon, fatalities, list_min(actors) as actor1,
list_max(actors) as actor2, description as notes from ev"""
    )
)
def conflict_feed(spark, d):
    """A conflict index's records, with numbers as texts."""
    item = F.struct(
        "event_type", F.col("category").alias("sub_event_type"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"), F.col("place").alias("location"), F.col("territory").alias("admin1"),
        F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"), F.col("fatalities").cast("string").alias("fatalities"),
        F.array_min("actors").alias("actor1"), F.array_max("actors").alias("actor2"), F.col("description").alias("notes"),
    )
    return landed.conflict_events(_payloads(ev(spark, d), item, lambda xs: F.struct(F.lit(True).alias("success"), xs.alias("data"))))


@query(
    """select strftime(ts, '%Y-%m-%d') as date, date_trunc('minute', ts) as ts, cast(event_id % 800 as double) / 100 as lat, cast(user_id % 90 as double) as lon, value as brightness,
case when event_id % 7 <> 0 then cast(event_id % 50 as double) end as frp, 'n' as confidence, case when hour(ts) between 6 and 17 then 'D' else 'N' end as daynight from events"""
)
def thermal_feed(spark, d):
    """Thermal points of CSV payloads, times without leading zeros."""
    cells = [
        "cast(event_id % 800 as double) / 100", "cast(user_id % 90 as double)", "value", "date_format(ts, 'yyyy-MM-dd')", "cast(cast(date_format(ts, 'HHmm') as int) as string)", "'n'",
        "case when event_id % 7 <> 0 then cast(cast(event_id % 50 as double) as string) else '-' end", "case when hour(ts) between 6 and 17 then 'D' else 'N' end",
    ]
    lines = table(spark, d, "events").withColumn("line", F.concat_ws(",", *[F.expr(f"cast({c} as string)") for c in cells]))
    head = "latitude,longitude,bright_ti4,acq_date,acq_time,confidence,frp,daynight"
    csv = lines.groupBy(F.floor(F.col("event_id") / 50)).agg(F.concat(F.lit(head + "\r\n"), F.array_join(F.collect_list("line"), "\r\n")).alias("payload"))
    return landed.thermal_points(csv.select("payload").unionByName(spark.range(1).select(F.lit("<html>busy</html>").alias("payload"))))


_ORG = "case event_id % 6 when 0 then 'UN OCHA' when 1 then 'Monusco' when 2 then 'Oxfam' when 3 then 'World Vision' when 4 then 'Some Daily' else '' end"


@query(
    sql(
        f"""r as (select event_id, {_ORG} as org, concat(case when event_id % 2 = 0 then 'The state of ' else 'Etat de ' end, place) as title, description from ev)
select case event_id % 6 when 0 then 'ocha' when 1 then 'monusco' when 2 then 'ngo_field' when 3 then 'ngo_field' else 'reliefweb' end as source_type, concat('reliefweb:', event_id) as source_id,
    case when org = '' then 'ReliefWeb' else org end as handle, trim(concat(title, '. ', description, ' more')) as text, case when event_id % 2 = 0 then 'en' else 'fr' end as lang from r"""
    )
)
def relief_feed(spark, d):
    """Relief reports by their publishers."""
    title = F.concat(F.expr("case when event_id % 2 = 0 then 'The state of ' else 'Etat de ' end"), "place")
    fields = F.struct(title.alias("title"), F.concat("description", F.lit(" \n more")).alias("body"), F.array(F.struct(F.lit(None).cast("string").alias("shortname"), F.expr(_ORG).alias("name"))).alias("source"))
    item = F.struct(F.col("event_id").cast("string").alias("id"), fields.alias("fields"))
    out = landed.relief_reports(_payloads(ev(spark, d), item, lambda xs: F.struct(xs.alias("data"))))
    return out.select("source_type", "source_id", "handle", "text", "lang")




@query(
    """with o as (select event_id % 12 + 2010 as year, count(*) as r, cast(sum(user_id) as bigint) as i from events where event_id % 12 < 9 group by 1),
a as (select event_id % 12 + 2010 as year, count(*) * 2 as h from events where event_id % 12 > 3 group by 1), m as (select event_id % 12 + 2010 as year, count(*) * 3 as m from events group by 1)
select cast(coalesce(o.year, a.year, m.year) as int) as year, r as refugees_abroad, cast(null as bigint) as asylum_seekers_abroad, i as idps_unhcr, r + 1 as returned_idps, h as refugees_hosted, m as idps_idmc
from m full join o using (year) full join a using (year)"""
)
def displacement_years(spark, d):
    """Three yearly series as one; a dash is no number."""
    y = table(spark, d, "events").withColumn("year", F.pmod("event_id", F.lit(12)) + 2010)

    def payload(rows, **columns):
        each = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("u"))
        item = F.struct("year", *[c.cast("string").alias(k) for k, c in columns.items()])
        return each.agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))

    n = F.col("n")
    origin = payload(y.where("year < 2019"), refugees=n, asylum_seekers=F.lit("-"), idps=F.col("u"), returned_idps=n + 1)
    return landed.displacement(origin, payload(y.where("year > 2013"), refugees=n * 2), payload(y, total=n * 3))


@query(
    sql(
        """select cast(event_id as varchar) as icao, handle as callsign, case when event_id % 3 = 0 then 'X' end as country, lon, lat, value as alt, event_id % 2 = 0 as on_ground, cast(event_id % 300 as double) as velocity,
cast(null as double) as heading from ev where event_id % 11 <> 0"""
    )
)
def aircraft_states(spark, d):
    """State vectors by position in an array; those without a place are left out."""
    text = lambda c: F.expr(f"cast({c} as string)")
    item = F.array(
        text("event_id"), F.concat("handle", F.lit("  ")), text("case when event_id % 3 = 0 then 'X' end"), F.lit("0"), F.lit("0"), text("case when event_id % 11 <> 0 then lon end"), text("lat"), text("value"),
        text("event_id % 2 = 0"), text("event_id % 300"), F.lit(None).cast("string"),
    )
    return landed.aircraft(_payloads(ev(spark, d), item, lambda xs: F.struct(xs.alias("states"))))


@query(
    sql(
        """f as (select strftime(ts, '%Y-%m-%d') as date, strftime(date_trunc('minute', ts), '%H%M') as hm, date_trunc('minute', ts) as moment, cast(event_id % 800 as double) / 100 as lat,
    cast(user_id % 90 as double) as lon, value as brightness, case when event_id % 7 <> 0 then cast(event_id % 50 as double) end as frp from events),
c as (select *, strftime(ts, '%Y-%m-%d') as date from ev)
select concat('acled:', date, ':', printf('%.3f', lat), ':', printf('%.3f', lon), ':', event_type) as source_id, 'acled' as source_type,
    concat(description, case when fatalities > 0 then concat(' ', fatalities, ' morts rapportés.') else '' end, ' Localité : ', place, ', ', coalesce(territory, ''), '.') as text,
    date_trunc('day', ts) + interval 12 hour as created_at, lat as geo_lat, lon as geo_lon, 5.0e0 as geo_radius_km, 'raw.news' as topic, cast(null as double) as frp, cast(null as double) as brightness from c
union all select concat('firms:', date, ':', hm, ':', printf('%.4f', lat), ':', printf('%.4f', lon)), 'firms',
    concat('Anomalie thermique VIIRS détectée. Puissance radiative ', coalesce(printf('%.1f', frp), '?'), ' MW, luminosité ', cast(floor(brightness + 0.5) as bigint), ' K, confiance capteur n.'),
    moment, lat, lon, 0.4e0, 'raw.sensors', coalesce(frp, 0), brightness from f"""
    )
)
def bridged_reports(spark, d):
    """Records of the conflict index and thermal points as reports."""
    both = bridge.conflict_reports(conflict_feed(spark, d)).unionByName(bridge.thermal_reports(thermal_feed(spark, d)))
    return both.drop("handle", "url", "lang")


@query(
    sql(
        """select concat('DON', event_id) as id, trim(case when event_id % 3 = 0 then concat('Update on ', place) else event_type end) as title, date_trunc('second', ts) as published, description as summary
from ev where event_id % 11 <> 0"""
    )
)
def outbreak_feed(spark, d):
    """Outbreak notices; those without an id are left out."""
    item = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("PublicationDate"), F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("Summary"), F.col("event_type").alias("Title"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" Update on "), "place")).otherwise("").alias("OverrideTitle"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("DON"), F.col("event_id"))).otherwise("").alias("DonId"),
    )
    return landed.outbreak_notices(_payloads(ev(spark, d), item, lambda xs: F.struct(xs.alias("value"))))


@query(
    sql(
        """g as (select place as donor, cast(sum(event_id % 97) as double) as funding from ev group by place), t as (select sum(funding) as total from g),
n as (select *, row_number() over (order by funding desc, donor) as rank from g)
select total, donor, funding, cast(rank as integer) as rank, 'Plan of 2024' as plan, 2 * total as required, 0.5e0 as coverage from n, t where rank <= 8"""
    )
)
def funding_feed(spark, d):
    """The largest donors of a year's flows, with its plan, whose requirements were revised."""
    given = ev(spark, d).groupBy("place").agg(F.sum(F.col("event_id") % 97).cast("double").alias("totalFunding"))
    names = given.agg(F.sum("totalFunding").alias("total"), F.collect_list(F.struct(F.col("place").alias("name"), "totalFunding")).alias("one"))  # fifty places
    totals = F.struct("total", F.array(F.struct(F.col("one").alias("singleFundingObjects"))).alias("objects"))
    flows = names.select(F.to_json(F.struct(F.struct(F.struct(totals.alias("fundingTotals")).alias("report1")).alias("data"))).alias("payload"))
    plan = lambda i, year, original, revised: F.struct(
        F.lit(i).alias("id"), F.struct(F.lit(f"Plan of {year}").alias("name")).alias("planVersion"), F.array(F.struct(F.lit(str(year)).alias("year"))).alias("years"),
        original.alias("origRequirements"), revised.alias("revisedRequirements"),
    )
    plans = names.select(F.to_json(F.struct(F.array(plan(1, 2023, F.lit(1.0), F.lit(2.0)), plan(2, 2024, F.col("total"), 2 * F.col("total"))).alias("data"))).alias("payload"))
    return landed.funding(flows, plans, 2024)
