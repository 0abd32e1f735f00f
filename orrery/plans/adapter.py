"""Event-shaped views of the ``events`` table, by integer arithmetic on its ids, alike in Spark and in DuckDB.

``ev`` has one row an event; ``rp`` one row a contributing report (one to three an event).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import EVENT_TYPES, SOURCE_PROFILES, STATUSES

NOW = datetime(2024, 1, 31)
NOW_SQL = "timestamp '2024-01-31 00:00:00'"

#: Columns of ev that are the same text in both engines.
EV = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "value": "value",
    "lat": "-4 + ((event_id*37) % 8000)/1000.0e0",
    "lon": "27 + ((user_id*91 + event_id) % 4000)/1000.0e0",
    "radius_km": "1.0e0 + (event_id % 9)",
    "time_uncertainty_min": "cast(30 + (event_id % 4) * 60 as bigint)",
    "fatalities": "case when event_id % 4 <> 0 then cast(floor(value/25) as bigint) end",
    "displaced": "case when event_id % 6 = 0 then event_id % 400 end",
    "confidence": "((event_id*17) % 89 + 5)/100.0e0",
    "priority": "(event_id*31) % 101",
    "independent_sources": "1 + event_id % 3",
    "province": "concat('province-', user_id % 6)",
    "territory": "case when event_id % 8 <> 0 then concat('territory-', user_id % 20) end",
    "place": "concat('Place ', event_id % 50)",
    "handle": "concat('@u', user_id)",
    "source_id": "concat(case when event_id % 10 = 0 then 'syn-' else 'src:' end, event_id % 977)",
    "origin": "case when event_id % 10 = 0 then 'simulated' else 'collected' end",
    "decision": "case event_id % 50 when 0 then 'confirm' when 1 then 'reject' when 2 then 'edit' end",
    "t_idx": "(event_id*13 + user_id) % 20",
    "s_idx": "(event_id*5 + user_id) % 6",
    "f_idx": "(event_id*7 + user_id) % 27",
    "lag_min": "(event_id*11) % 720",
}
DIMS = {
    "dim_type": ("t_idx, event_type, category, severity", [(i, *t) for i, t in enumerate(EVENT_TYPES)]),
    "dim_status": ("s_idx, status", list(enumerate(STATUSES))),
    "dim_source": ("f_idx, source_type, family, grade, credibility, strength", [(i, *s) for i, s in enumerate(SOURCE_PROFILES)]),
}
#: Columns of rp, over ev and j (0, 1, 2).
RP = {
    "event_id": "event_id",
    "j": "j",
    "ts": "ts",
    "lat": "lat",
    "lon": "lon",
    "f_idx": "(event_id*7 + user_id + j*5) % 27",
    "source_id": "concat(case when (event_id + j) % 10 = 0 then 'syn-' else 'src:' end, (event_id*3 + j) % 977)",
    "simulated": "(event_id + j) % 10 = 0",
    "report_confidence": "((event_id*19 + j*37) % 97)/100.0e0",
    "agreement": "case when (event_id + j) % 11 = 0 then 'contradict' when (event_id + j) % 7 = 0 then 'partial' else 'agree' end",
}


def values(rows: list[tuple]) -> str:
    """Rows as SQL text; doubles are doubles in both engines."""
    one = lambda x: f"{x!r}e0" if isinstance(x, float) and "e" not in repr(x) else "null" if x is None else repr(x)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dim(spark: SparkSession, name: str) -> DataFrame:
    """A fixed table of a few dozen rows."""
    columns, rows = DIMS[name]
    return F.broadcast(spark.sql(f"select * from values {values(rows)} as t({columns})"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*[f"{x} as {c}" for c, x in EV.items()])
    for name, key in (("dim_type", "t_idx"), ("dim_status", "s_idx"), ("dim_source", "f_idx")):
        rows = rows.join(dim(spark, name), key)
    return (
        rows.withColumn("ingested_at", F.timestamp_add("MINUTE", "lag_min", "ts"))
        .withColumn("updated_at", F.timestamp_add("MINUTE", F.col("lag_min") + 60, "ts"))
        .withColumn("actors", F.array_distinct(F.array(F.concat(F.lit("actor-"), F.col("user_id") % 25), F.concat(F.lit("actor-"), F.col("event_id") % 25))))
        .withColumn("description", F.concat("event_type", F.lit(" near "), "place", F.lit(" by "), "handle"))
    )


def rp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*[f"{EV[c]} as {c}" for c in ("event_id", "ts", "user_id", "lat", "lon")])
    each = rows.selectExpr("*", "explode(sequence(0, cast(event_id % 3 as int))) as j")
    return each.selectExpr(*[f"{x} as {c}" for c, x in RP.items()]).join(dim(spark, "dim_source"), "f_idx").withColumn("published_at", F.timestamp_add("HOUR", "j", "ts"))


def _ctes() -> str:
    dims = [f"{name}({columns}) as (values {values(rows)})" for name, (columns, rows) in DIMS.items()]
    base = ", ".join(f"{x} as {c}" for c, x in EV.items())
    each = ", ".join(f"{x} as {c}" for c, x in RP.items())
    return ",\n".join(
        [
            *dims,
            f"ev0 as (select {base} from events)",
            """ev as (
    select *, ts + to_minutes(cast(lag_min as integer)) as ingested_at, ts + to_minutes(cast(lag_min + 60 as integer)) as updated_at,
        list_distinct([concat('actor-', user_id % 25), concat('actor-', event_id % 25)]) as actors,
        concat(event_type, ' near ', place, ' by ', handle) as description
    from ev0 join dim_type using (t_idx) join dim_status using (s_idx) join dim_source using (f_idx)
)""",
            "rp0 as (select *, unnest(range(0, cast(event_id % 3 as integer) + 1)) as j from ev0)",
            f"rp as (select r.*, d.* exclude (f_idx), ts + to_hours(cast(j as integer)) as published_at from (select {each} from rp0) r join dim_source d using (f_idx))",
            "act as (select * from ev where status not in ('merged', 'rejected'))",
        ]
    )


CTES = _ctes()


def sql(query: str) -> str:
    """A query over ev, rp and act (active events) as DuckDB SQL; it may begin with further CTEs (``x as (...)``)."""
    q = query.strip()
    return f"with {CTES}\n{q}" if q.lower().startswith("select") else f"with {CTES},\n{q}"
