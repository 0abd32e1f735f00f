"""Queries over typed events of the conflict index, thermal points and drones, and over ids that sort by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import typed_feed as tf
from .adapter import NOW, ev, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A typed event in both engines, over ev: one in five is a drone's sighting, one in five a thermal point.
TYPED = {
    "event_id": "event_id",
    "src": "case event_id % 5 when 0 then 'drone' when 1 then 'firms' when 2 then 'cop' else 'acled' end",
    "type": "case event_id % 7 when 0 then 'Battles' when 1 then 'Explosions/Remote violence' when 2 then 'Strategic developments' when 3 then 'Violence against civilians' else event_type end",
    "subtype": "case when event_id % 3 = 0 then 'Armed clash' when event_id % 3 = 1 then 'Shelling' end",
    "location": "place",
    "admin1": "territory",
    "fatalities": "fatalities",
    "actor1": "case when event_id % 4 <> 0 then handle end",
    "actor2": "cast(null as varchar(9))",
    "notes": "case event_id % 6 when 0 then concat('Des DÉPLACÉS vers ', place) when 1 then description end",
    "desc": "case when event_id % 5 = 0 then concat('Convoy at ', place) end",
    "platform": "case when event_id % 5 = 0 then 'UAS' end",
}
_DATE = {"spark": "case when event_id % 9 <> 0 then date_format(ts, 'yyyy-MM-dd') end", "sql": "case when event_id % 9 <> 0 then strftime(ts, '%Y-%m-%d') end"}
_CTE = "t as (select " + ", ".join(f'{x} as "{c}"' for c, x in TYPED.items()) + f", ts, {_DATE['sql']} as date from ev)"


def typed(spark, d):
    return ev(spark, d).selectExpr(*[f"{x.replace('varchar(9)', 'string')} as `{c}`" for c, x in TYPED.items()], "ts", f"{_DATE['spark']} as date")


def query(oracle):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql(oracle)
        return f

    return keep


def _holds(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


_ANY = "(" + " or ".join(f"""contains(lower(coalesce("{c}", '')), 'place 1')""" for c in tf.SEARCHED) + ")"


@query(f"{_CTE} select event_id, '{tf.SECRET}' as classification from t where src = 'drone' and (date is null or date >= '2024-01-24') and {_ANY}")
def feed_by_classification(spark, d):
    """What a week's drones saw near places whose names begin alike; undated sightings stay."""
    return tf.filtered(typed(spark, d), NOW, "PLACE 1", "7d", tf.SECRET).select("event_id", tf.classification().alias("classification"))


@query(
    f"{_CTE}, k as (select *, lower(concat(type, coalesce(subtype, ''))) as w from t), "
    + "a as ("
    + " union all ".join(f"select event_id, '{k}' as kind from k where {_holds('w', ws)}" + (" or src = 'firms'" if k == "humanitarian" else "") for k, ws in tf.KINDS.items())
    + ") select kind, count(*) as n, min(event_id) as first, max(event_id) as last from a group by kind"
)
def feed_by_kind(spark, d):
    events = typed(spark, d)
    kinds = F.array_compact(F.array(*[F.when(tf.of_kind(k), F.lit(k)) for k in tf.KINDS]))
    each = events.select("event_id", F.explode(kinds).alias("kind"))  # an event may be of several
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query(f"{_CTE} select event_id, ts from t where src = 'acled' and {_holds(chr(34) + 'w' + chr(34), tf.KINDS['battle'])} order by ts desc, event_id limit {tf.PAGE}".replace('"w"', "lower(concat(type, coalesce(subtype, '')))"))
def feed_page(spark, d):
    """The newest page of the index's battles."""
    return tf.page(tf.filtered(typed(spark, d), NOW, src="acled", kind="battle"), [F.desc("ts"), F.col("event_id")]).select("event_id", "ts")


@query(
    f"""{_CTE} select event_id, coalesce(fatalities, 0) >= {tf.DEADLY} or type = 'Battles' as alerts, type = 'Strategic developments' as reports,
    {_holds("lower(coalesce(notes, ''))", tf.MOVING)} as movements, src in ('drone', 'firms') or type = 'Explosions/Remote violence' as fires from t"""
)
def activity_tabs(spark, d):
    return typed(spark, d).select("event_id", *[tf.in_activity(t).alias(t.lower()) for t in ("ALERTS", "REPORTS", "MOVEMENTS", "FIRES")])


def _digits_sql(x: str, digits: int) -> str:
    return " || ".join(f"substr('{ids.DIGITS}', cast((({x}) >> {5 * i}) & 31 as integer) + 1, 1)" for i in range(digits - 1, -1, -1))


@query(
    f"""h as (select event_id, epoch_us(ts) // 1000 as ms, sha256(concat(event_id, chr(31), handle)) as s from ev),
n as (select event_id, ms, ('0x' || substr(s, 1, 10))::bigint as a, ('0x' || substr(s, 11, 10))::bigint as b from h)
select event_id, {_digits_sql('ms', 10)} || {_digits_sql('a', 8)} || {_digits_sql('b', 8)} as id from n"""
)
def time_ids(spark, d):
    return ev(spark, d).select("event_id", ids.time_id(F.col("ts"), F.col("event_id"), F.col("handle")).alias("id"))
