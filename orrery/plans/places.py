"""Queries over positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import geo, weather
from ..operators import spatial
from .adapter import ev, sql, table, values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep



def km(lat1, lon1, lat2, lon2):
    return (
        f"(2 * 6371.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


_POINTS = f"pts(kind, name, la, lo) as (values {values(dims.POINTS)})"
_PLACES = f"places(name, la, lo, pop, radius, kind, province) as (values {values([p[:7] for p in dims.PLACES])})"
_EDGES = "edges(ring, name, x1, y1, x2, y2) as (values " + values(
    [(i, n, *map(float, (a[0], a[1], b[0], b[1]))) for i, (n, r) in enumerate(dims.RINGS) for a, b in zip(r, [*r[1:], r[0]], strict=True)]
) + ")"


@query(
    sql(
        f"""{_POINTS}, k as (select event_id, kind, name, {km('lat', 'lon', 'la', 'lo')} as km from ev, pts)
select event_id, kind, arg_min(name, km) as name, round(min(km), 6) as km from k group by 1, 2"""
    )
)
def haversine_nearest(spark, d):
    each = F.array(*[F.struct(F.lit(k).alias("kind"), spatial.nearest_point(k).alias("n")) for k in dims.POINT_KINDS])
    out = ev(spark, d).select("event_id", F.inline(each).alias("kind", "n"))
    return out.select("event_id", "kind", "n.name", F.round("n.km", 6).alias("km"))


@query(
    sql(
        f"""s(i, la, lo) as (select s_suppkey, -4 + (s_suppkey * 61 % 8000) / 1000.0e0, 27 + (s_suppkey * 37 % 4000) / 1000.0e0 from supplier)
select event_id, i as feature, round({km('lat', 'lon', 'la', 'lo')}, 6) as km from ev, s where {km('lat', 'lon', 'la', 'lo')} <= 25"""
    )
)
def within_radius(spark, d):
    f = table(spark, d, "supplier").selectExpr("s_suppkey as feature", "-4 + (s_suppkey * 61 % 8000) / 1000.0e0 as lat", "27 + (s_suppkey * 37 % 4000) / 1000.0e0 as lon")
    return spatial.within_km(ev(spark, d).select("event_id", "lat", "lon"), f, 25.0).select("event_id", "feature", F.round("km", 6).alias("km"))


@query(
    sql(
        f"""{_PLACES}, k as (select event_id, name, {km('lat', 'lon', 'la', 'lo')} as km from ev, places)
select event_id, arg_min(name, km) filter (km <= 40) as feature, round(min(km) filter (km <= 40), 6) as km from k group by 1"""
    )
)
def reverse_geocode(spark, d):
    f = spark.sql(f"select name as feature, la as lat, lo as lon from values {values([p[:3] for p in dims.PLACES])} as t(name, la, lo)")
    out = spatial.nearest_within(ev(spark, d), f, 40.0, "event_id")
    return out.withColumn("km", F.round("km", 6))


_PIP = f"""{_EDGES}, c as (select event_id, ring, name from ev, edges
    where (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1),
inside as (select event_id, ring, name from c group by all having count(*) % 2 = 1)"""


@query(sql(f"{_PIP} select event_id, arg_min(name, ring) as province_at from ev left join inside using (event_id) group by 1"))
def pip_province(spark, d):
    return ev(spark, d).select("event_id", spatial.province_at(F.col("lat"), F.col("lon")).alias("province_at"))


@query(sql(f"{_PIP} select event_id, name from inside"))
def pip_join(spark, d):
    pts = [(n, [(float(x), float(y)) for x, y in r]) for n, r in dims.RINGS]
    rings = spark.createDataFrame(pts, "name string, ring array<struct<x: double, y: double>>")
    return spatial.points_in_rings(ev(spark, d), rings, "event_id")


_SEGMENTS = values([(i, n, *map(float, (*a, *b))) for i, (n, line) in enumerate(dims.AXES) for a, b in zip(line, line[1:], strict=False)])


@query(
    sql(
        f"""seg(i, name, x1, y1, x2, y2) as (values {_SEGMENTS}),
p as (select event_id, i, name, (x1 - lon) * 111.32e0 * cos(radians(lat)) as ax, (y1 - lat) * 110.57e0 as ay, (x2 - x1) * 111.32e0 * cos(radians(lat)) as dx, (y2 - y1) * 110.57e0 as dy from ev, seg),
t as (select *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) as t from p),
k as (select event_id, i, name, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) as km from t)
select event_id, name as axis, round(km, 4) as km from k qualify row_number() over (partition by event_id order by round(km, 9), i) = 1"""
    )
)
def axis_distance(spark, d):
    return ev(spark, d).select("event_id", spatial.nearest_axis().alias("n")).select("event_id", F.col("n.name").alias("axis"), F.round("n.km", 4).alias("km"))


_RURAL = "case prov " + " ".join(f"when '{k}' then {v}e0" for k, v in dims.RURAL_DENSITY.items()) + f" else {dims.RURAL_DEFAULT}e0 end"
_PROV = "case user_id % 5 when 0 then 'Northreach' when 1 then 'Southreach' when 2 then 'Eastmark' when 3 then 'Westvale' end"
_BELL = f"""coalesce(sum(pop / (pi() * pow(greatest(1, radius), 2)) * exp(-0.5e0 * pow(km / greatest(2, radius * 0.8e0), 2))) filter (km <= 3 * greatest(2, radius * 0.8e0)), 0)"""


@query(
    sql(
        f"""{_PLACES}, k as (select event_id, {_PROV} as prov, pop, radius, {km('lat', 'lon', 'la', 'lo')} as km from ev, places)
select event_id, cast(floor({_RURAL} + {_BELL} + 0.5e0) as bigint) as density from k group by event_id, prov"""
    )
)
def population_density(spark, d):
    return ev(spark, d).select("event_id", spatial.population_density(F.col("lat"), F.col("lon"), F.expr(_PROV)).alias("density"))


@query(
    sql(
        f"""{_PLACES}, pick as (select event_id, lat, lon, greatest(1.0e0, radius_km) as r, {_PROV} as prov from ev ),
ring as (select unnest([0, 1, 2, 3]) as i), az as (select unnest(range(8)) as k),
s as (select event_id, r, prov, i, k, case when i = 0 then 1 else 8 end as n, lat + r * (i + 0.5e0) / 4 * cos(2 * pi() * k / 8) / 110.57e0 as la0,
    lon + r * (i + 0.5e0) / 4 * sin(2 * pi() * k / 8) / (111.32e0 * cos(radians(lat))) as lo0 from pick, ring, az where i > 0 or k = 0),
q as (select event_id, r, i, k, n, prov, pop, radius, {km('la0', 'lo0', 'la', 'lo')} as km from s, places),
dens as (select event_id, r, i, k, n, floor({_RURAL} + {_BELL} + 0.5e0) as dd from q group by event_id, r, i, k, n, prov),
m as (select event_id, i, sum(dd) / n * r * r * pi() * (pow(i + 1, 2) - pow(i, 2)) / 16 as x from dens group by event_id, i, n, r)
select event_id, cast(floor(sum(x) + 0.5e0) as bigint) as at_risk from m group by 1"""
    )
)
def population_at_risk(spark, d):
    rows = ev(spark, d).select("event_id", "lat", "lon", "radius_km", F.expr(_PROV).alias("province"))
    return spatial.with_population_at_risk(rows, "at_risk").select("event_id", "at_risk")


def _boxes(boxes):
    return " or ".join(f"(lat > {s} and lat < {n} and lon > {w} and lon < {e})" for s, n, w, e in boxes)


@query(
    sql(
        f"""{_PLACES}, k as (select event_id, lat, lon, name, pop, kind, {km('lat', 'lon', 'la', 'lo')} as km from ev, places),
n as (select event_id, lat, lon, min(km) as km, arg_min(kind = 'city' or pop > 200000, km) as big from k group by all),
lake(la, lo, r) as (values {values([x[1:] for x in dims.LAKES])}),
wet as (select distinct event_id from ev, lake where {km('lat', 'lon', 'la', 'lo')} < r * 0.55e0)
select n.event_id, case when wet.event_id is not null then 'lacustrine' when km <= 12 and big then 'urban' when {_boxes(dims.HIGHLAND)} then 'highland'
    when {_boxes(dims.FOREST)} then 'forest' else 'agricultural' end as terrain from n left join wet using (event_id)"""
    )
)
def terrain_class(spark, d):
    return ev(spark, d).select("event_id", spatial.terrain(F.col("lat"), F.col("lon")).alias("terrain"))


@query()
def geo_enrichment(spark, d):
    rows = ev(spark, d).select("event_id", "lat", "lon", "radius_km", F.expr(_PROV).alias("known_province"))
    return spatial.enrich(rows)


_GRID = "k as (select c_custkey, (c_custkey * 7919 % 168001) / 1000.0e0 - 82 as lat, (c_custkey * 104729 % 360000) / 1000.0e0 - 180 as lon from customer)"


@query(
    f"""with {_GRID},
z as (select *, case when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32 when lat >= 72 and lon >= 0 and lon < 9 then 31 when lat >= 72 and lon >= 9 and lon < 21 then 33
    when lat >= 72 and lon >= 21 and lon < 33 then 35 when lat >= 72 and lon >= 33 and lon < 42 then 37 else least(60, cast(floor((lon + 180) / 6) as int) + 1) end as z from k),
p as (select *, radians(lat) as f, radians(lon - (z * 6 - 183)) as l, {geo.ECC2}e0 as e, {geo.ECC2}e0 / (1 - {geo.ECC2}e0) as g from z where lat between -80 and 84),
q as (select *, {geo.AXIS_M}e0 / sqrt(1 - e * sin(f) ** 2) as n, tan(f) ** 2 as t, g * cos(f) ** 2 as c, cos(f) * l as a from p),
u as (select *, {geo.SCALE}e0 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * g) * a ** 5 / 120) + 500000 as east,
    {geo.SCALE}e0 * ({geo.AXIS_M}e0 * ((1 - e / 4 - 3 * e ** 2 / 64 - 5 * e ** 3 / 256) * f - (3 * e / 8 + 3 * e ** 2 / 32 + 45 * e ** 3 / 1024) * sin(2 * f)
        + (15 * e ** 2 / 256 + 45 * e ** 3 / 1024) * sin(4 * f) - (35 * e ** 3 / 3072) * sin(6 * f))
        + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * g) * a ** 6 / 720)) as north from q),
w as (select *, cast(floor(east) as bigint) as x, cast(floor(north + case when north < 0 then 10000000 else 0 end) as bigint) as y from u),
m as (select c_custkey, concat(z, substr('{geo.BANDS}', least(20, cast(floor((lat + 80) / 8) as int) + 1), 1), substr('{geo.COLUMNS}', ((z - 1) % 3) * 8 + x // 100000, 1),
    substr('{geo.ROWS}', (y // 100000 + case when z % 2 = 0 then 5 else 0 end) % 20 + 1, 1), lpad(cast(x % 100000 // 10 as varchar), 4, '0'), lpad(cast(y % 100000 // 10 as varchar), 4, '0')) as grid from w)
select c_custkey, grid, concat(printf('%.4f', abs(lat)), '°', case when lat >= 0 then 'N' else 'S' end, '  ', printf('%.4f', abs(lon)), '°', case when lon >= 0 then 'E' else 'W' end) as position
from k left join m using (c_custkey)"""
)
def grid_references(spark, d):
    """Grid references to ten metres of points all over the world; null near the poles."""
    k = table(spark, d, "customer").selectExpr("c_custkey", "(c_custkey * 7919 % 168001) / 1000.0e0 - 82 as lat", "(c_custkey * 104729 % 360000) / 1000.0e0 - 180 as lon")
    return k.select("c_custkey", geo.mgrs(F.col("lat"), F.col("lon"), 4).alias("grid"), geo.position_text(F.col("lat"), F.col("lon")).alias("position"))


@query(
    sql(
        f"""s(i, la, lo, label) as (select s_suppkey, -4 + (s_suppkey * 61 % 8000) / 1000.0e0, 27 + (s_suppkey * 37 % 4000) / 1000.0e0, s_name from supplier),
a as (select event_id, lat, lon, 8.0e0 * (1 + event_id % 5) as r from ev),
k as (select event_id, i, label, {km('lat', 'lon', 'la', 'lo')} as km, r from a, s), o as (select *, row_number() over (partition by event_id order by km, i) as n from k where km <= r),
m as (select event_id, count(*) as n, string_agg(label, '–' order by n) as x from o where n <= 3 group by 1)
select event_id, case when m.n > 1 then concat('axe ', x) when m.n = 1 then x else printf('%.3f, %.3f', lat, lon) end as name, cast(coalesce(m.n, 0) as int) as n from a left join m using (event_id)"""
    )
)
def area_names(spark, d):
    """What areas around events are called by the nearest settlements in them."""
    f = table(spark, d, "supplier").selectExpr("s_suppkey as feature", "s_name as label", "-4 + (s_suppkey * 61 % 8000) / 1000.0e0 as lat", "27 + (s_suppkey * 37 % 4000) / 1000.0e0 as lon")
    return spatial.named_areas(ev(spark, d).selectExpr("event_id", "lat", "lon", "8.0e0 * (1 + event_id % 5) as radius_km"), f, "event_id")


#: Weather at an event, the same in both engines, each value now and then unknown.
_WEATHER = {
    "base": "case when event_id % 5 <> 0 then event_id * 37 % 2500 end",
    "sight": "case when event_id % 4 <> 0 then event_id * 91 % 14000 end",
    "cover": "case when event_id % 3 <> 0 then event_id * 13 % 101 end",
    "r24": "case when event_id % 7 > 1 then event_id * 17 % 50 end",
    "r72": "case when event_id % 6 > 1 then event_id * 29 % 110 end",
}


@query(
    f"""with w as (select event_id, {', '.join(f'{x} as {c}' for c, x in _WEATHER.items())} from events)
select event_id, case when base is null and sight is null and cover is null then 'INCONNU' when base < 600 or sight < 3000 then 'DÉFAVORABLE'
    when base < 1500 or sight < 8000 or cover > 80 then 'DÉGRADÉ' else 'FAVORABLE' end as observation,
case when r24 is null and r72 is null then 'INCONNU' when coalesce(r24, 0) > 40 or coalesce(r72, 0) > 90 then 'IMPRATICABLE'
    when coalesce(r24, 0) > 12 or coalesce(r72, 0) > 35 then 'DIFFICILE' else 'PRATICABLE' end as mobility from w"""
)
def weather_bands(spark, d):
    """What weather allows at each event: seeing from the air, and moving on unpaved roads."""
    w = table(spark, d, "events").selectExpr("event_id", *[f"{x} as {c}" for c, x in _WEATHER.items()])
    seen = weather.observation_band(F.col("base"), F.col("sight"), F.col("cover"))
    return w.select("event_id", seen.alias("observation"), weather.mobility_band(F.col("r24"), F.col("r72")).alias("mobility"))
