"""Queries over links between reports, reliability, confidence and priority."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.stats import grade_p
from ..operators import fusion, linkage, spatial
from ..storage import cut, stored
from ..streaming import recluster
from .adapter import NOW, NOW_SQL, dim, ev, rp, sql, table
from .places import km

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


#: Columns of a record that are the same text in both engines, over ev and j (0 to 2).
REC = {
    "id": "event_id * 10 + j",
    "j": "j",
    "lat": "case when (event_id + j) % 13 <> 0 then lat + j * 0.02e0 end",
    "lon": "case when (event_id + j) % 13 <> 0 then lon + j * 0.01e0 end",
    "radius_km": "radius_km",
    "time_uncertainty_min": "time_uncertainty_min",
    "fatalities": "fatalities + 3 * j * (event_id % 5)",
    "source_key": "concat('src:', (event_id * 3 + j) % 977)",
    "prior": "0.3e0 + ((event_id + j * 7) % 60) / 100.0e0",
    "place": "place",
    "handle": "handle",
    "t_idx": "(t_idx + case when event_id % 3 = 0 then j else 0 end) % 20",
}


def rec(spark, d):
    each = ev(spark, d).selectExpr("*", "explode(sequence(0, cast(event_id % 3 as int))) as j")
    actors = "array_distinct(array(concat('actor-', user_id % 25), concat('actor-', (event_id + j) % 25))) as actors"
    rows = each.selectExpr("timestampadd(HOUR, 2 * j, ts) as ts", actors, *[f"{x} as {c}" for c, x in REC.items()])
    return rows.join(dim(spark, "dim_type").select("t_idx", "event_type"), "t_idx").selectExpr("*", "concat(event_type, ' near ', place, ' by ', handle, ' report ', j) as description")


def fold(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s-]', ' ', 'g'), '[\\s_-]+', ' ', 'g'))"


_REC = f"""rec0 as (select *, unnest(range(0, cast(event_id % 3 as integer) + 1)) as j from ev),
rec1 as (select ts + to_hours(cast(2 * j as integer)) as ts, list_distinct([concat('actor-', user_id % 25), concat('actor-', (event_id + j) % 25)]) as actors,
    {', '.join(f'{x} as {c}' for c, x in REC.items())} from rec0),
rec as (select rec1.*, event_type, concat(event_type, ' near ', place, ' by ', handle, ' report ', j) as description from rec1 join dim_type using (t_idx))"""
_CAND = f"""{_REC},
k as (select id, ts, event_type, radius_km, lat, cast(floor(epoch(ts) / 21600) as bigint) as b, cast(floor(lat / 0.1e0) as bigint) as cy, cast(floor(lon / 0.1e0) as bigint) as cx,
    {fold("array_to_string(list_sort(actors), '|')")} as who from rec),
loc as (select *, cast(greatest(1, least(2, ceil(radius_km / 11))) as integer) as r from k where lat is not null),
idx as (select id, ts, b, concat('c:', cy, ':', cx) as key from loc union all select id, ts, b, concat('a:', who) from k where lat is null
    union all select id, ts, b, concat('y:', event_type) from k where lat is null),
q0 as (select id, ts, b, concat('c:', cy + dy, ':', cx + dx) as key from loc, range(-2, 3) y(dy), range(-2, 3) x(dx) where abs(dy) <= r and abs(dx) <= r
    union all select id, ts, b, concat('y:', event_type) from k union all select id, ts, b, concat('a:', who) from k where lat is null),
qry as (select id, ts, b + o as b, key from q0, (values (-1), (0), (1)) v(o)),
pr as (select distinct q.id, i.id as c, abs(epoch(q.ts) - epoch(i.ts)) as gap from qry q join idx i using (b, key) where q.id <> i.id),
cand as (select distinct least(id, c) as a, greatest(id, c) as b from (select * from pr qualify row_number() over (partition by id order by gap, c) <= 80))"""


@query(sql(f"{_CAND} select a, b from cand"))
def block_candidates(spark, d):
    return linkage.candidates(rec(spark, d))


_KIN = " or ".join(f"(x.event_type, y.event_type) in (('{p}', '{q}'), ('{q}', '{p}'))" for p, q in dims.TYPE_AFFINITY)
_SCORED = f"""{_CAND},
g as (select *, list_distinct(list_transform(range(1, len(f) + 1), lambda i: substr(' ' || f || ' ', i, 3))) as grams from (select *, {fold('description')} as f from rec)),
m as (select a, cand.b as b, x.source_key = y.source_key as same, {km('x.lat', 'x.lon', 'y.lat', 'y.lon')} as km, x.radius_km as rx, y.radius_km as ry,
    exp(-0.5e0 * pow(abs(epoch(x.ts) - epoch(y.ts)) / 60.0e0 / greatest(30.0e0, sqrt(pow(x.time_uncertainty_min, 2) + pow(y.time_uncertainty_min, 2))), 2)) as tv,
    case when x.event_type = y.event_type then 1.0e0 when {_KIN} then 0.5e0 else 0.0e0 end as yv,
    len(list_intersect(x.actors, y.actors)) * 1.0e0 / len(list_distinct(list_concat(x.actors, y.actors))) as av,
    2.0e0 * len(list_intersect(x.grams, y.grams)) / (len(x.grams) + len(y.grams)) as dv,
    case when x.fatalities is null or y.fatalities is null then null when greatest(x.fatalities, y.fatalities) = 0 then 1.0e0
        else least(x.fatalities, y.fatalities) * 1.0e0 / greatest(x.fatalities, y.fatalities) end as cr, greatest(x.fatalities, y.fatalities) as most
    from cand join g x on x.id = a join g y on y.id = cand.b),
w as (select *, exp(-0.5e0 * pow(km / greatest(3.0e0, sqrt(pow(rx, 2) + pow(ry, 2))), 2)) as gv,
    case when cr is null then 1.0e0 when most = 0 or cr > 0.5e0 then 1.0e0 when cr > 0.25e0 then 0.55e0 + 0.45e0 * 0.6e0 when cr > 0.1e0 then 0.55e0 + 0.45e0 * 0.25e0 else 0.55e0 end as gate from m),
s as (select *, (0.26e0 * tv + coalesce(0.3e0 * gv, 0) + 0.16e0 * yv + 0.14e0 * av + 0.14e0 * dv) / (0.7e0 + case when gv is null then 0 else 0.3e0 end) * gate as raw from w),
scored as (select a, b, case when same then 1.0e0 when km > greatest(60, rx + ry + 25) then least(raw, 0.2e0) else raw end as score from s)"""


@query(sql(f"{_SCORED} select a, b, round(score, 6) as score from scored"))
def pair_scores(spark, d):
    return linkage.scored(rec(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


def _clustered(spark, d):
    r = rec(spark, d)
    return r, linkage.grouped(r)[0]


@query()
def cluster_map(spark, d):
    return _clustered(spark, d)[1]


@query()
def review_pairs(spark, d):
    return linkage.clustered_pairs(rec(spark, d))


@query()
def reclustered(spark, d):
    """The reports as three landings of a stream, ten days each; of an earlier landing the last week is still open."""
    r, none = rec(spark, d), spark.createDataFrame([], "cluster_id long")
    state, limits = recluster.empty_state(r), recluster.Limits(grace=timedelta(days=7), most=None)
    ends = [NOW - timedelta(days=20), NOW - timedelta(days=10)]
    for landed in (F.col("ts") < F.lit(ends[0]), F.col("ts").between(F.lit(ends[0]), F.lit(ends[1])), F.col("ts") > F.lit(ends[1])):
        state = recluster.flush(state, r.where(landed), none, limits)
    return state.select("id", "ts", "cluster_id", "frozen", "late")


def _by_place(spark, d):
    """Records with injured, displaced and a stand of their own, in clusters of one place, type family and day."""
    r = rec(spark, d).withColumns({"injured": F.expr("id % 31"), "displaced": F.expr("case when id % 4 = 0 then id % 900 end"), "agreement": F.expr("case when id % 11 = 0 then 'contradict' else 'agree' end")})
    r = cut(r.withColumn("source_key", F.expr("concat('src:', id % 3)")))
    day = F.struct("place", F.col("ts").cast("date").alias("day"))
    return r, r.select("id", F.min("id").over(Window.partitionBy(day)).alias("cluster_id"))


_BY_PLACE = f"""{_REC},
x0 as (select * exclude (source_key), concat('src:', id % 3) as source_key, id % 31 as injured, case when id % 4 = 0 then id % 900 end as displaced,
    case when id % 11 = 0 then 'contradict' else 'agree' end as agreement, min(id) over (partition by place, cast(ts as date)) as cluster_id from rec)"""


@query(
    sql(
        f"""{_BY_PLACE},
x as (select *, case when lat is not null then 1 / pow(greatest(0.5e0, radius_km), 2) end as w from x0 qualify row_number() over (partition by cluster_id, source_key order by ts, id) = 1),
v as (select cluster_id, event_type, round(sum(prior), 9) as v, min(id) as i from x group by all),
k as (select cluster_id, event_type from v qualify row_number() over (partition by cluster_id order by v desc, i) = 1),
b as (select cluster_id, source_key as base_source, description from x qualify row_number() over (partition by cluster_id order by prior desc, coalesce(radius_km, 999), ts, id) = 1),
t as (select cluster_id, description from x qualify row_number() over (partition by cluster_id order by len(description) desc, id) = 1)
select x.cluster_id, k.event_type, count(*) as reports, base_source, round(sum(w * lat) / sum(w), 9) as lat, round(sum(w * lon) / sum(w), 9) as lon,
    round(greatest(0.75e0 * min(radius_km) filter (lat is not null), sqrt(1 / sum(w))), 9) as radius_km, min(ts) as ts, min(time_uncertainty_min) as time_uncertainty_min,
    cast(floor(quantile_cont(fatalities, 0.5) + 0.5) as bigint) as fatalities, max(injured) as injured, max(displaced) as displaced, t.description
from x join k using (cluster_id) join b using (cluster_id) join t using (cluster_id) group by x.cluster_id, k.event_type, base_source, t.description"""
    )
)
def merged_by_place(spark, d):
    r, found = _by_place(spark, d)
    out = linkage.merge_clusters(r, linkage.one_a_source(r, found))
    return out.select(
        "cluster_id", "event_type", "reports", "base_source", *[F.round(c, 9).alias(c) for c in ("lat", "lon", "radius_km")], "ts", "time_uncertainty_min", "fatalities", "injured", "displaced", "description"
    )


@query(
    sql(
        f"""{_BY_PLACE}, v as (select cluster_id, event_type, round(sum(prior), 9) as v, min(id) as i from x0 group by all),
k as (select cluster_id, event_type as kind from v qualify row_number() over (partition by cluster_id order by v desc, i) = 1)
select id, cluster_id, case when agreement = 'contradict' then agreement when event_type = kind then 'agree' else 'partial' end as agreement from x0 join k using (cluster_id)"""
    )
)
def agreement_marks(spark, d):
    return linkage.agreement_marks(*_by_place(spark, d))


@query()
def merged_events(spark, d):
    r, found = _clustered(spark, d)
    return linkage.merge_clusters(r, linkage.one_a_source(r, found))


_GRADE_P = "case grade " + " ".join(f"when '{k}' then {v}e0" for k, v in dims.GRADE_P.items()) + " end"


@query(
    sql(
        f"""o as (select user_id % 27 as f_idx, value > 20 as ok, (1 + event_id % 3) * pow(0.5e0, greatest(0, epoch({NOW_SQL}) - epoch(ts)) / 86400.0e0 / 90.0e0) as w from events),
s as (select f_idx, coalesce(sum(w) filter (ok), 0) as sa, coalesce(sum(w) filter (not ok), 0) as sb, coalesce(sum(w), 0) as n from o group by 1),
p as (select source_type, {_GRADE_P} * strength + coalesce(sa, 0) as a, (1 - {_GRADE_P}) * strength + coalesce(sb, 0) as b, coalesce(n, 0) as n from dim_source left join s using (f_idx))
select source_type, round(a / (a + b), 6) as mean, round(sqrt(a * b / (pow(a + b, 2) * (a + b + 1))), 6) as sd, round(n, 4) as n,
    case when a / (a + b) >= 0.9e0 then 'A' when a / (a + b) >= 0.75e0 then 'B' when a / (a + b) >= 0.58e0 then 'C' when a / (a + b) >= 0.33e0 then 'D'
        when a / (a + b) >= 0.1e0 then 'E' else 'F' end as posterior_grade from p"""
    )
)
def reliability_posterior(spark, d):
    o = table(spark, d, "events").selectExpr("user_id % 27 as f_idx", "value > 20 as correct", "cast(1 + event_id % 3 as double) as weight", "ts as at")
    out = fusion.posterior(dim(spark, "dim_source").withColumn("f_idx", F.col("f_idx").cast("long")), o, ["f_idx"], NOW)
    return out.select("source_type", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("n", 4).alias("n"), "posterior_grade")


def _evidence(spark, d):
    """Reports with the prior reliability of their sources, spread in place and time."""
    p = grade_p(F.col("grade"))
    rows = rp(spark, d).withColumns({"mean": p, "sd": F.sqrt(p * (1 - p) / (F.col("strength") + 1)), "report_id": F.col("event_id") * 10 + F.col("j")})
    return rows.selectExpr(
        "event_id", "report_id", "family", "mean", "sd", "credibility", "agreement", "report_confidence", "published_at",
        "timestampadd(HOUR, 4 * j, ts) as ts", "lat + j * 0.05e0 as lat", "lon", "case event_id % 50 when 0 then 'confirm' when 1 then 'reject' end as decision",
    )


_RHO = "case family " + " ".join(f"when '{k}' then {v}e0" for k, v in dims.FAMILY_RHO.items()) + " end"
_CRED_P = "case credibility " + " ".join(f"when {k} then {v}e0" for k, v in dims.CREDIBILITY_P.items()) + " end"
_FUSED = f"""e0 as (select event_id, j, event_id * 10 + j as report_id, family, {_GRADE_P} as mean, sqrt({_GRADE_P} * (1 - {_GRADE_P}) / (strength + 1)) as sd, credibility, agreement,
    report_confidence, published_at, ts + to_hours(cast(4 * j as integer)) as ts, lat + j * 0.05e0 as lat, lon, {_RHO} as rho, {_CRED_P} as cp from rp),
e1 as (select *, greatest(0.05e0, least(0.93e0, 0.5e0 + (mean - 0.5e0) * (0.4e0 + 0.6e0 * cp))) as p,
    case when credibility = 5 and agreement = 'contradict' then -0.9e0 when credibility >= 5 then 0.45e0 when credibility = 4 then 0.85e0 else 1.0e0 end as sure,
    pow(rho, row_number() over (partition by event_id, family order by report_confidence desc, report_id) - 1) as w from e0),
e2 as (select *, (ln(p / (1 - p)) - ln(0.45e0 / 0.55e0)) * (1 - least(0.6e0, sd * 1.6e0)) * sure as x from e1),
e3 as (select *, w * case agreement when 'contradict' then -abs(x) * 0.8e0 when 'partial' then x * 0.6e0 else x end as wx from e2),
far as (select a.event_id, max({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}) as km from e0 a join e0 b using (event_id) group by 1),
e4 as (select event_id, count(*) as n, sum(wx) as x, sum(w) as en, count(distinct family) as fam, (epoch(max(ts)) - epoch(min(ts))) / 3600.0e0 as hrs,
    (epoch({NOW_SQL}) - epoch(max(published_at))) / 3600.0e0 as age from e3 group by 1),
e5 as (select event_id, en, fam, ln(0.45e0 / 0.55e0) + x + case when fam >= 2 then 0.42e0 * ln(fam) else 0 end
    + case when n < 2 then 0 else case when km <= 5 then 0.28e0 when km <= 20 then 0.12e0 when km <= 50 then 0 else -0.35e0 end
        + case when hrs <= 3 then 0.22e0 when hrs <= 12 then 0.1e0 when hrs <= 36 then 0 else -0.25e0 end end
    - case when en < 2 and age > 24 then least(0.85e0, 0.18e0 * log2(age / 24 + 1)) else 0 end as odds from e4 join far using (event_id)),
fused as (select event_id, fam as independent_sources, en as effective_n,
    case event_id % 50 when 0 then 0.97e0 when 1 then 0.03e0 else greatest(0.05e0, least(0.93e0, 1 / (1 + exp(-odds)))) end as confidence from e5)"""


@query(sql(f"{_FUSED} select event_id, independent_sources, round(effective_n, 6) as effective_n, round(confidence, 6) as confidence from fused"))
def confidence_fused(spark, d):
    out = fusion.fuse(_evidence(spark, d), NOW)
    return out.select("event_id", "independent_sources", F.round("effective_n", 6).alias("effective_n"), F.round("confidence", 6).alias("confidence"))


@query(
    sql(
        f"""select event_id, cast(floor(100 * (0.34e0 * severity + 0.22e0 * least(1.0e0, coalesce(fatalities, 0) / 25.0e0) + 0.18e0 * least(1.0e0, log10(1 + event_id % 9000) / 5)
    + 0.26e0 * exp(-greatest(0.0e0, (epoch({NOW_SQL}) - epoch(ts)) / 3600.0e0) / 72)) * (0.35e0 + 0.65e0 * confidence) + 0.5e0) as bigint) as score from ev"""
    )
)
def priority_scored(spark, d):
    risk = F.expr("event_id % 9000")
    score = fusion.priority(F.col("severity"), F.col("fatalities"), F.lit(None).cast("long"), risk, F.col("ts"), F.col("confidence"), NOW)
    return ev(spark, d).select("event_id", score.alias("score"))


@query(
    sql(
        f"""{_FUSED}, n as (select event_id, count(*) filter (agreement = 'agree') as ok, count(*) filter (agreement = 'contradict') as bad from rp group by 1)
select event_id, case event_id % 50 when 0 then 'confirmed' when 1 then 'rejected' else case when bad > 0 and bad * 2 >= ok then 'disputed'
    when independent_sources >= 2 and round(confidence, 9) >= 0.6e0 then 'corroborated' else 'unverified' end end as status from fused join n using (event_id)"""
    )
)
def event_status(spark, d):
    rows = _evidence(spark, d)
    n = rows.groupBy("event_id").agg(F.count_if(F.col("agreement") == "agree").alias("ok"), F.count_if(F.col("agreement") == "contradict").alias("bad"), F.max("decision").alias("decision"))
    fused = fusion.fuse(rows, NOW).join(n, "event_id")
    c = F.round("confidence", 9)
    return fused.select("event_id", fusion.status(F.col("decision"), F.col("ok"), F.col("bad"), F.col("independent_sources"), c).alias("status"))


@query()
def events_enriched(spark, d):
    """Merged events with their surroundings: the whole chain from reports to enriched incidents."""
    r, found = _clustered(spark, d)
    out = stored(linkage.merge_clusters(r, found))  # read twice
    return spatial.enrich(out.withColumn("known_province", F.lit(None).cast("string")))

