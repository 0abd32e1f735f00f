"""Queries over feeds, tallies and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed, series, tallies
from .adapter import NOW, NOW_SQL, ev, rp, sql, table

KEPT = ["event_id", "ts", "event_type", "status", "priority"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def back(hours: int) -> str:
    return f"({NOW_SQL} - interval {hours} hour)"


CUR = f"ts >= {back(24 * 7)} and ts < {NOW_SQL}"
PREV = f"ts >= {back(24 * 14)} and ts < {back(24 * 7)}"
PERIOD_H = 24 * 7
BACKED = "status in ('confirmed', 'corroborated')"
INCIDENT = "category not in ('sensor', 'other')"


@query(sql("select event_id, ts, event_type, status, priority from act"))
def active_events(spark, d):
    return feed.active(ev(spark, d)).select(*KEPT)


@query(
    sql(
        f"""select event_id, ts, event_type, status, priority from act
where ts >= {back(168)} and category = 'conflict' and province = 'province-3' and origin <> 'simulated'
and contains(lower(concat_ws(' ', description, place, province, coalesce(territory, ''), list_aggregate(actors, 'string_agg', ' '), handle)), 'place 1')
and contains(lower(concat_ws(' ', description, place, province, coalesce(territory, ''), list_aggregate(actors, 'string_agg', ' '), handle)), 'actor-1')"""
    )
)
def feed_filter(spark, d):
    out = feed.filter_feed(ev(spark, d), NOW, "7d", "Pláce Actor-1", "conflict", None, "province-3", True)
    return out.where(F.lower("description").contains("place 1")).select(*KEPT)


@query(
    sql(
        f"""select event_id, ts, event_type, status, priority from ev
where (decision is null or decision = 'edit') and status <> 'merged' and (status = 'disputed' or (
    epoch({NOW_SQL}) - epoch(ts) <= 96 * 3600 and (priority >= 45 or (independent_sources = 1 and (coalesce(fatalities, 0) >= 3 or priority >= 30)))))"""
    )
)
def triage_queue(spark, d):
    return feed.queue(ev(spark, d), "triage", NOW).select(*KEPT)


@query(sql("select event_id, ts, event_type, status, priority from ev where priority >= 55 and status <> 'rejected'"))
def alert_queue(spark, d):
    return feed.queue(ev(spark, d), "alerts", NOW).select(*KEPT)


@query(sql("select event_id, ts, event_type, status, priority from ev where decision is not null"))
def adjudicated_queue(spark, d):
    return feed.queue(ev(spark, d), "adjudicated", NOW).select(*KEPT)


@query(
    sql(
        """select event_id, 'enriched' as sink from ev
union all select event_id, 'alerts' from ev where priority >= 55 and status <> 'rejected'
union all select event_id, 'triage' from ev where decision is null and (status = 'disputed' or (priority >= 45 and confidence < 0.55e0)
    or (independent_sources = 1 and coalesce(fatalities, 0) >= 5))"""
    )
)
def event_routes(spark, d):
    return feed.routes(ev(spark, d)).select("event_id", F.explode("sinks").alias("sink"))


@query(
    sql(
        """select event_id, priority, decision from ev where decision is not null
union all (select event_id, priority, decision from ev where decision is null order by priority desc, event_id limit 1500)"""
    )
)
def top_priority_capped(spark, d):
    return feed.cap_by_priority(ev(spark, d), 1500).select("event_id", "priority", "decision")


@query(sql("select event_id, ts from ev order by ts desc, event_id limit 400"))
def newest_active_set(spark, d):
    return feed.newest(ev(spark, d), 400).select("event_id", "ts")


@query(sql(f"select event_id, priority, confidence from act where {CUR} and confidence >= 0.45e0 order by priority desc, event_id limit 6"))
def highlights(spark, d):
    cur, _ = tallies.periods(NOW, PERIOD_H)
    return feed.highlights(feed.active(ev(spark, d)).where(cur)).select("event_id", "priority", "confidence")


@query(sql("select event_id, case when sum(case when simulated then 1 else 0 end) = 0 then 'collected' when count(*) = sum(case when simulated then 1 else 0 end) then 'simulated' else 'mixed' end as origin from rp group by 1"))
def event_origin(spark, d):
    r = rp(spark, d).groupBy("event_id").agg(F.count_if("simulated").alias("s"), F.count(F.lit(1)).alias("n"))
    return r.select("event_id", feed.origin_of(F.col("s"), F.col("n")).alias("origin"))


@query("select event_id, user_id from events where user_id not in (select c_custkey from customer where c_custkey % 3 = 0)")
def anti_ingest(spark, d):
    seen = table(spark, d, "customer").where("c_custkey % 3 = 0").withColumnRenamed("c_custkey", "user_id")
    return feed.not_seen(table(spark, d, "events"), seen, "user_id").select("event_id", "user_id")


def _tally(key: str) -> str:
    return sql(
        f"select {key} as key, count(*) as count, cast(sum(coalesce(fatalities, 0)) as bigint) as fatalities, count(*) filter ({BACKED}) as confirmed from act where {key} is not null and {key} <> '' group by 1"
    )


@query(_tally("event_type"))
def tally_type(spark, d):
    return tallies.tally_by(feed.active(ev(spark, d)), F.col("event_type"))


@query(_tally("handle"))
def tally_user(spark, d):
    return tallies.tally_by(feed.active(ev(spark, d)), F.col("handle"))


@query(_tally("territory"))
def tally_territory(spark, d):
    return tallies.tally_by(feed.active(ev(spark, d)), F.col("territory"))


def _situation(hours: int | None) -> str:
    cur = f"ts >= {back(hours)}" if hours else "true"
    prev = f"ts >= {back(2 * hours)} and ts < {back(hours)}" if hours else "false"
    return sql(
        f"""s as (
    select count(*) filter ({cur}) as total, count(*) filter ({prev}) as before,
        count(*) filter ({cur} and category = 'conflict') as conflict, count(*) filter ({cur} and category = 'humanitarian') as humanitarian,
        count(*) filter ({cur} and category = 'political') as political, count(*) filter ({cur} and {BACKED}) as backed,
        cast(coalesce(sum(fatalities) filter ({cur}), 0) as bigint) as fatalities, cast(coalesce(sum(displaced) filter ({cur}), 0) as bigint) as displaced,
        count(*) filter ({cur} and origin = 'simulated') as simulated, max(updated_at) filter ({cur}) as freshest
    from act where {INCIDENT}
)
select total, conflict, humanitarian, political, fatalities, displaced, simulated, freshest,
    cast(backed as double) / nullif(total, 0) as corroborated_share, (total - before) * 100.0e0 / nullif(before, 0) as change_pct from s"""
    )


@query(_situation(168))
def situation(spark, d):
    return tallies.situation(ev(spark, d), "7d", NOW)


@query(_situation(None))
def situation_all(spark, d):
    return tallies.situation(ev(spark, d), "all", NOW)


@query(sql("select family, count(*) as reports, count(*) filter (simulated) as simulated from rp group by 1"))
def family_mix(spark, d):
    return tallies.family_mix(rp(spark, d))


_DELTA = "case when p = 0 then case when c = 0 then 0.0e0 end else (c - p) * 100.0e0 / p end"
_SIG = "(c + p >= 5 and abs(c - p) > 1.96e0 * sqrt(c + p))"


@query(
    sql(
        f"""k as (
    select 'type' as kind, event_type as label, ts, 2 as least from act union all select 'place', coalesce(territory, province), ts, 3 from act
), n as (select kind, label, least, count(*) filter ({CUR}) as c, count(*) filter ({PREV}) as p from k group by all)
select kind, label, c as current, p as previous, {_DELTA} as delta_pct, {_SIG} as significant,
    case when c > p then 'up' when c < p then 'down' else 'flat' end as direction from n where c + p >= least"""
    )
)
def trend_lines(spark, d):
    return tallies.trend_lines(ev(spark, d), NOW, PERIOD_H)


@query(
    sql(
        f"""n as (select actor, count(*) filter ({CUR}) as c, count(*) filter ({PREV}) as p from (select ts, unnest(actors) as actor from act) group by 1)
select actor, c as current, p as previous, {_DELTA} as delta_pct from n where c + p >= 2 order by c desc, actor limit 8"""
    )
)
def actor_activity(spark, d):
    return tallies.actor_activity(ev(spark, d), NOW, PERIOD_H)


@query(
    sql(
        f"""select count(*) as total, count(*) filter (status = 'confirmed') as confirmed, count(*) filter (status = 'corroborated') as corroborated,
    count(*) filter (status = 'unverified') as unverified, count(*) filter (status = 'disputed') as disputed,
    cast(sum(coalesce(fatalities, 0)) as bigint) as fatalities, cast(sum(coalesce(case when event_id % 5 = 0 then fatalities - 1 end, fatalities, 0)) as bigint) as fatalities_low,
    cast(sum(coalesce(case when event_id % 5 = 0 then fatalities + 2 end, fatalities, 0)) as bigint) as fatalities_high,
    cast(sum(coalesce(displaced, 0)) as bigint) as displaced from act where {CUR}"""
    )
)
def sitrep_counts(spark, d):
    ranged = ev(spark, d).withColumn("fatalities_low", F.expr("case when event_id % 5 = 0 then fatalities - 1 end"))
    return tallies.period_counts(ranged.withColumn("fatalities_high", F.expr("case when event_id % 5 = 0 then fatalities + 2 end")), NOW, PERIOD_H)


@query(sql(f"select handle from act where ts >= {back(720)} group by 1 having count(*) filter (ts >= {back(72)} and ts < {NOW_SQL}) = 0"))
def silent_groups(spark, d):
    return tallies.silent(ev(spark, d), "handle", NOW, 72)


@query(
    sql(
        f"""l as (select lag_min as lag, row_number() over (order by lag_min) - 1 as i, count(*) over () as n from act where {CUR} and lag_min >= 0)
select lag / 60.0e0 as lag_hours, cast(n as bigint) as n from l where i = n // 2"""
    )
)
def lag_median(spark, d):
    return tallies.upper_median_lag(ev(spark, d), NOW, PERIOD_H)


@query(
    sql(
        """g as (select event_id, lat, lon, floor((lon + 180) / 360 * 256 * 64 / 52) as cx,
    floor((0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 64 / 52) as cy from ev)
select round(avg(lat), 8) as lat, round(avg(lon), 8) as lon, count(*) as n, min(event_id) as first_id from g group by cx, cy"""
    )
)
def grid_cluster(spark, d):
    g = tallies.grid_clusters(ev(spark, d), 6)
    return g.withColumn("lat", F.round("lat", 8)).withColumn("lon", F.round("lon", 8))


@query(
    sql(
        """c as (select province, event_type, count(*) as n, min(event_id) as f from ev group by all)
select province, arg_max(event_type, n * 1000000000 - f) as dominant, max(n) as n from c group by 1"""
    )
)
def dominant_type(spark, d):
    return tallies.dominant(ev(spark, d), "province", "event_type", "event_id")


@query(
    sql(
        """c as (select event_type, count(*) as n from ev group by 1), r as (select *, row_number() over (order by n desc, event_type) as k from c)
select case when k <= 4 then event_type else 'other' end as label, cast(sum(n) as bigint) as n, sum(n) * 100.0e0 / (select sum(n) from c) as share from r group by 1"""
    )
)
def type_donut(spark, d):
    return tallies.top_and_rest(ev(spark, d), "event_type")


@query(sql("select province, cast(sum(displaced) as bigint) as displaced from act where displaced > 0 group by 1"))
def displaced_by_place(spark, d):
    return tallies.by_place_displaced(feed.active(ev(spark, d)))


_DAILY = f"""cal as (select cast(unnest(range(date '2024-01-02', date '2024-02-01', interval 1 day)) as date) as day),
n as (select cast(ts as date) as day, count(*) as total, count(*) filter (category = 'conflict') as conflict, count(*) filter (category = 'humanitarian') as humanitarian,
    count(*) filter (category = 'political') as political from act where {INCIDENT} group by 1),
daily as (select day, coalesce(total, 0) as total, coalesce(conflict, 0) as conflict, coalesce(humanitarian, 0) as humanitarian, coalesce(political, 0) as political from cal left join n using (day))"""


@query(sql(f"{_DAILY} select * from daily"))
def daily_series(spark, d):
    return series.daily_series(ev(spark, d), 30, NOW)


@query(
    sql(
        f"""{_DAILY}, i as (select *, row_number() over (order by day) - 1 as i from daily)
select min(day) as start, cast(sum(total) as bigint) as total from i where i >= 30 % 7 group by (i - 30 % 7) // 7"""
    )
)
def weekly_series(spark, d):
    return series.weekly_series(series.daily_series(ev(spark, d), 30, NOW))


@query(
    sql(
        """b as (select date_diff('day', cast(ts as date), date '2024-01-30') as k from ev),
c as (select count(*) filter (k = 6) as d6, count(*) filter (k = 5) as d5, count(*) filter (k = 4) as d4, count(*) filter (k = 3) as d3, count(*) filter (k = 2) as d2,
    count(*) filter (k = 1) as d1, count(*) filter (k = 0) as d0 from b)
select *, (d2 + d1 + d0 - d6 - d5 - d4) * 100.0e0 / greatest(d6 + d5 + d4, 1) as trend_pct from c"""
    )
)
def sparkline_trend(spark, d):
    return series.sparkline_trend(ev(spark, d), NOW.replace(day=30))


@query(
    f"""select user_id, round(sum(value) filter (ts <= {NOW_SQL} - interval 2 day and ts >= {NOW_SQL} - interval 5 day), 6) as total,
count(*) filter (ts <= {NOW_SQL} - interval 2 day and ts >= {NOW_SQL} - interval 5 day) as n from events group by 1"""
)
def trailing_sum(spark, d):
    return series.trailing_sum(table(spark, d, "events"), "user_id", NOW.replace(day=29), 72, 6)


@query(
    f"""select user_id, max(ts) as ts, arg_max(value, (ts, value)) as value from events where ts <= {NOW_SQL} - interval 5 day and value is not null group by 1"""
)
def asof_latest(spark, d):
    return series.latest_as_of(table(spark, d, "events"), "user_id", NOW.replace(day=26))


_RUNS = """h as (select user_id, ts, event_id, value > 25 as hit, value > 60 as low from events),
i as (select *, count(*) filter (not hit) over (partition by user_id order by ts, event_id) as island from h),
r as (select *, case when hit then count(*) filter (hit) over (partition by user_id, island order by ts, event_id) else 0 end as run from i)"""


@query(f"with {_RUNS} select event_id, cast(run as bigint) as run from r")
def hit_runs(spark, d):
    return series.runs(table(spark, d, "events"), "user_id", F.col("value") > 25, ["ts", "event_id"]).select("event_id", "run")


@query(
    f"""with {_RUNS}, l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from r)
select user_id, cast(run as bigint) as run, run >= 2 and low as outage from l where k = 1"""
)
def outage_runs(spark, d):
    rows = table(spark, d, "events").withColumn("hit", F.col("value") > 25).withColumn("drop", F.col("value") > 60)
    return series.outages(rows, "user_id", ["ts", "event_id"], 2)


@query(
    """with s as (select user_id, cast(ts as date) as day, sum(value) as value from events group by all),
m as (select user_id, day, round(value, 4) as value, avg(value) over (partition by user_id order by day rows between 7 preceding and 1 preceding) as m, value as v from s)
select user_id, day, value, round(m, 4) as week_mean, round(v / nullif(m, 0), 4) as ratio from m"""
)
def moving_ratio(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("value"))
    out = series.moving_ratio(s, "user_id", "day")
    return out.select("user_id", "day", *[F.round(c, 4).alias(c) for c in ("value", "week_mean", "ratio")])


@query("select event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 48")
def history_cap(spark, d):
    return series.last_of(table(spark, d, "events"), "user_id", ["ts", "event_id"], 48).select("event_id")


@query(
    f"""with w as (select user_id, value > 20 as ok, (1 + event_id % 3) * pow(0.5e0, greatest(0, epoch({NOW_SQL}) - epoch(ts)) / 86400.0e0 / 90.0e0) as w from events)
select user_id, round(sum(case when ok then w else 0 end), 6) as alpha, round(sum(case when not ok then w else 0 end), 6) as beta, round(sum(w), 6) as n from w group by 1"""
)
def observation_decay(spark, d):
    o = table(spark, d, "events").selectExpr("user_id", "value > 20 as correct", "cast(1 + event_id % 3 as double) as weight", "ts as at")
    return series.decayed(o, ["user_id"], NOW).select("user_id", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "n")])
