"""Queries over the classification of reports, name scans, half-space scores, and logs of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text
from ..operators import anomaly, reports, scanner
from ..operators import classify as rules
from .adapter import NOW, NOW_SQL, ev, sql, table, values
from .texts import fold, unmark
from .views import CUR, PERIOD_H, PREV, back

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


#: A report's text and actors over ev, the same in both engines.
_SAYS = """concat(description, case when event_id % 9 = 0 then ' Coups de feu' else '' end, case when event_id % 7 = 0 then ', situation calme' else '' end,
    case when event_id % 5 = 0 then '; match de football' else '' end, case when event_id % 4 = 1 then ' Selon la Mission' else '' end)"""
_WHO = [a[0] for a in dims.ACTORS]
_NAMES = [f"case when event_id % {n} = 0 then {w!r} end" for w, n in zip(_WHO, (3, 4, 5, 7, 2), strict=True)]
_CUES = [(i, k, w, c, j) for i, (k, w, cues) in enumerate(rules.RULES) for j, c in enumerate(cues)]
_HABITS = [(i + 1, n, k, j) for i, (n, _, habits, _) in enumerate(dims.ACTORS) for j, k in enumerate(habits)]
_SIDES = [(i, n, side) for i, (n, side, _, _) in enumerate(dims.ACTORS)]
_VIOLENT = ", ".join(map(repr, rules.VIOLENT))


#: The classifier over said (event_id, f: the folded text, who, dead, moved, taken, hurt): t has kinds, e the cues.
CLASSES = f"""cue(i, kind, w, cue, j) as (values {values(_CUES)}), habit(i, name, kind, j) as (values {values(_HABITS)}), side(i, name, side) as (values {values(_SIDES)}),
foe(p, q) as (values {values([x for p in dims.OPPOSED for x in (p, p[::-1])])}),
calm(i, kind, cue) as (values {values([(i, k, c) for i, (k, cues) in enumerate(rules.SUPPRESSORS) for c in cues])}), off(cue) as (values {values([(c,) for c in rules.OFF_TOPIC])}),
hit as (select event_id, i, kind, w, arg_min(cue, j) as cue from said join cue on contains(f, cue) group by all),
cut as (select distinct event_id, calm.i, kind from said join calm on contains(f, cue)),
armed as (select s.event_id, count(side.name) filter (side <> 'civilian') as n from said s left join side on list_contains(who, side.name) group by 1),
facing as (select event_id, count(distinct x.name) as n from said, side x, side y, foe where list_contains(who, x.name) and list_contains(who, y.name) and x.i < y.i and p = x.side and q = y.side group by 1),
point as (
    select event_id, kind, i as o, w * case when (event_id, kind) in (select (event_id, kind) from cut) then 0.25e0 else 1.0e0 end as w from hit
    union all select event_id, kind, 100 + i, 0.0e0 from cut
    union all select event_id, kind, 200 + i * 10 + j, {rules.HABIT}e0 from said join habit on list_contains(who, name)
    union all select event_id, 'armed_clash', 100000, n * {rules.FACING}e0 from facing
    union all select event_id, 'abduction', 100001, {rules.ABDUCTED}e0 from said where taken > 0
    union all select event_id, 'displacement', 100002, {rules.DISPLACED}e0 from said where moved > 0
    union all select event_id, 'armed_clash', 100003, {rules.INJURED}e0 from said where hurt > 0 and dead = 0
    union all select event_id, case when n <= 1 then 'massacre' else 'armed_clash' end, 100004, case when n <= 1 then {rules.MANY_DEAD}e0 else {rules.MANY_DEAD_FOUGHT}e0 end from said join armed using (event_id) where dead >= {rules.MANY}),
hard as (select event_id from said where dead > 0 or taken > 0 union select event_id from hit where kind in ({_VIOLENT})),
gone as (select event_id from said join off on contains(f, cue) where event_id not in (select event_id from hard)),
k as (select event_id, kind, round(sum(w), 9) as s, min(o) as o from point where not (kind in ({_VIOLENT}) and event_id in (select event_id from gone)) group by 1, 2),
r as (select *, exp(s / 2) / sum(exp(s / 2)) over (partition by event_id) as share, row_number() over (partition by event_id order by s desc, o) as n from k),
t as (select event_id, max(kind) filter (n = 1) as kind, max(share) filter (n = 1) as share, string_agg(kind, ',' order by n) filter (n between 2 and 4) as alts from r group by 1),
e as (select event_id, string_agg(cue, ',' order by i) as cues from hit group by 1)"""


@query(
    sql(
        f"""said as (select event_id, {fold(_SAYS)} as f, list_filter([{', '.join(_NAMES)}], lambda x: x is not null) as who, coalesce(fatalities, 0) as dead, coalesce(displaced, 0) as moved,
    case when event_id % 8 = 0 then 2 else 0 end as taken, event_id % 3 as hurt from ev), {CLASSES}
select event_id, coalesce(kind, 'unknown') as kind, round(coalesce(share, 0), 6) as score, coalesce(alts, '') as alts, case when kind is null then '' else coalesce(cues, '') end as evidence
from said left join t using (event_id) left join e using (event_id)"""
    )
)
def event_classes(spark, d):
    """The type that a report's words, actors and casualties speak for."""
    x = ev(spark, d).selectExpr("event_id", f"{_SAYS} as said", f"array_compact(array({', '.join(_NAMES)})) as who", "fatalities", "displaced", "case when event_id % 8 = 0 then 2 else 0 end as taken", "event_id % 3 as hurt")
    c = rules.classified(x, text.fold_key(F.col("said")), F.col("who"), F.col("fatalities"), F.col("hurt"), F.col("taken"), F.col("displaced"), "c")
    return c.select(
        "event_id", F.col("c.type").alias("kind"), F.round("c.score", 6).alias("score"), F.array_join("c.alts.type", ",").alias("alts"), F.array_join("c.evidence", ",").alias("evidence")
    )


@query()
def name_matches(spark, d):
    """The openings of benchmark items, of one to three words, in the texts of conversations."""
    items = table(spark, d, "benchmark").select("item_id", text.tokens(text.fold_key(F.coalesce("text", F.lit("")))).alias("w"))
    keys = items.select(F.col("item_id").alias("ord"), "w", F.explode(F.array(F.lit(3), F.lit(2), F.lit(1))).alias("n")).where(F.size("w") >= F.col("n"))
    keys = keys.select("ord", "n", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("key"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(text.fold_key(F.coalesce("text", F.lit("")))).alias("w"))
    found = scanner.matches_in(turns, keys, "w")
    return found.select("conv_id", "turn", "start", "end", F.col("ord").alias("item_id"), F.round("score", 6).alias("score"), "phrase")


@query()
def half_space_scores(spark, d):
    """How unlike the window before an event's value and time of day are, for each type of event."""
    x = table(spark, d, "events").select("event_type", "event_id", F.least(F.col("value") / 200, F.lit(1.0)).alias("height"), (F.hour("ts") / 24).alias("time"))
    return anomaly.half_space_scores(x, "event_type", "event_id", ["height", "time"]).withColumn("score", F.round("score", 9))


#: A log of reviews over the events, the same text in both engines.
_LOG = """event_id % 97 as report_id, event_id as seq, case when event_id < 97 then 'create' when (event_id * 7 + user_id) % 11 = 0 then 'version'
    when (event_id + user_id) % 3 = 0 then 'submit' when (event_id + user_id) % 3 = 1 then 'approve' else 'return' end as action,
    concat('u', user_id % 4) as actor, case when user_id % 5 = 0 then 'analyst' else 'operator' end as level, case when event_id % 4 <> 0 then 'unclear' else ' ' end as note"""


@query(
    f"""with recursive log as (select {_LOG} from events),
l as (select *, row_number() over (partition by report_id order by seq) as n from log),
run as (
    select report_id, n, seq, case when action in ('create', 'version') then 1 else 0 end as version, case when action in ('create', 'version') then actor end as author,
        case when action in ('create', 'version') then 'draft' end as state, action in ('create', 'version') as took_effect from l where n = 1
    union all
    select l.report_id, l.n, l.seq, r.version + case when l.action in ('create', 'version') then 1 else 0 end, case when l.action in ('create', 'version') then l.actor else r.author end,
        case when l.action in ('create', 'version') then 'draft' when r.version = 0 then null when l.action = 'submit' and r.state = 'draft' then 'in_review'
            when r.state = 'in_review' and l.level <> 'analyst' and l.actor <> r.author and l.action = 'approve' then 'approved'
            when r.state = 'in_review' and l.level <> 'analyst' and l.actor <> r.author and l.action = 'return' and trim(l.note) <> '' then 'draft' else r.state end,
        l.action in ('create', 'version') or (r.version > 0 and ((l.action = 'submit' and r.state = 'draft') or (r.state = 'in_review' and l.level <> 'analyst' and l.actor <> r.author
            and (l.action = 'approve' or (l.action = 'return' and trim(l.note) <> '')))))
    from run r join l on l.report_id = r.report_id and l.n = r.n + 1)
select report_id, seq, version, state, took_effect from run"""
)
def review_log(spark, d):
    """Which steps of a report's review took effect, and the state after each."""
    return reports.review_log(table(spark, d, "events").selectExpr(*_split(_LOG))).select("report_id", "seq", "version", "state", "took_effect")


@query()
def review_states(spark, d):
    return reports.review_states(table(spark, d, "events").selectExpr(*_split(_LOG)))


def _split(columns: str) -> list[str]:
    """The columns of a select list, cut at commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


@query(
    sql(
        f"""c as (select count(*) filter (independent_sources <= 1) as single_family, count(*) filter (lat is null) as unlocated, count(*) filter (status = 'disputed') as disputed, count(*) as total from act where {CUR}),
q as (select handle from act where ts >= {back(720)} group by 1 having count(*) filter ({CUR}) = 0),
l as (select lag_min as lag, row_number() over (order by lag_min) - 1 as i, count(*) over () as n from act where {CUR} and lag_min >= 0),
g as (select 'single_family' as gap, single_family as n, concat('of ', total) as detail from c union all select 'unlocated', unlocated, concat('of ', total) from c
    union all select 'disputed', disputed, concat('of ', total) from c
    union all select 'silent', (select count(*) from q), (select string_agg(handle, ', ' order by handle) from (select * from q order by handle limit 6))
    union all select 'slow', n, printf('%.1f h', lag / 60.0e0) from l where i = n // 2 and lag / 60.0e0 > 6)
select * from g where n > 0"""
    )
)
def period_gaps(spark, d):
    """What the picture of a period lacks."""
    return reports.gaps(ev(spark, d), NOW, PERIOD_H, "handle")


_LINE = "case when c > p then 'up' when c < p then 'down' else 'flat' end"
_ONE = "province-3"


@query(
    sql(
        f"""a as (select * from act where province = '{_ONE}'),
n as (select count(*) as total, count(*) filter (status = 'confirmed') as confirmed, count(*) filter (status = 'disputed') as disputed, cast(sum(coalesce(fatalities, 0)) as bigint) as fatalities,
    count(*) filter (independent_sources <= 1) as single from a where {CUR}),
h as (select event_id, priority from a where {CUR} and confidence >= 0.45e0 order by priority desc, event_id limit 6),
k as (select 'type' as kind, event_type as label, ts, 2 as least from a union all select 'place', coalesce(territory, province), ts, 3 from a),
t as (select kind, label, count(*) filter ({CUR}) as c, count(*) filter ({PREV}) as p from k group by kind, label, least having c + p >= least),
w as (select actor, count(*) filter ({CUR}) as c, count(*) filter ({PREV}) as p from (select ts, unnest(actors) as actor from a) group by 1 having c + p >= 2 order by c desc, actor limit 8),
q as (select handle from a where ts >= {back(720)} group by 1 having count(*) filter ({CUR}) = 0),
l as (select lag_min as lag, row_number() over (order by lag_min) - 1 as i, count(*) over () as n from a where {CUR} and lag_min >= 0),
g as (select 'single_family' as gap, single as n, concat('of ', total) as detail from n union all select 'disputed', disputed, concat('of ', total) from n
    union all select 'silent', (select count(*) from q), (select string_agg(handle, ', ' order by handle) from (select * from q order by handle limit 6))
    union all select 'slow', n, printf('%.1f h', lag / 60.0e0) from l where i = n // 2 and lag / 60.0e0 > 6),
s as (select province, event_id, ts, value > 25 as hit, value > 60 as low from ev),
i as (select *, count(*) filter (not hit) over (partition by province order by ts, event_id) as island from s),
r as (select *, count(*) filter (hit) over (partition by province, island order by ts, event_id) as run from i),
z as (select province, arg_max(case when hit then run else 0 end, (ts, event_id)) as run, arg_max(low, (ts, event_id)) filter (hit) as low, count(*) filter (hit) as hits from r where province = '{_ONE}' group by 1)
select '{_ONE}' as province, {back(PERIOD_H)} as period_start, {NOW_SQL} as period_end, total, confirmed, disputed, fatalities,
    (select coalesce(list(concat(event_id, ' ', priority) order by priority desc, event_id), []) from h) as highlights,
    (select coalesce(list(concat(kind, ' ', label, ' ', c, ' ', p, ' ', {_LINE}) order by (c + p >= 5 and abs(c - p) > 1.96e0 * sqrt(c + p)) desc, abs(c - p) desc, kind, label), []) from t) as trends,
    (select coalesce(list(concat(actor, ' ', c, ' ', p) order by c desc, actor), []) from w) as actors,
    (select coalesce(list(concat(gap, ' ', n, ' ', detail) order by gap), []) from g where n > 0) as gaps,
    (select coalesce(list(concat(province, ' ', case when run >= 3 and low then '{reports.DEGRADED}' when hits > 0 then '{reports.WATCHED}' else '{reports.NOMINAL}' end, ' ', run)), []) from z) as connectivity
from n"""
    )
)
def situation_report(spark, d):
    """A province's week as one row, its connectivity with it."""
    events = ev(spark, d)
    samples = events.select("province", "ts", "event_id", (F.col("value") > 25).alias("hit"), (F.col("value") > 60).alias("drop"))
    out = reports.sitrep(events.selectExpr("*", "fatalities as fatalities_low", "fatalities as fatalities_high"), NOW, PERIOD_H, _ONE, reports.connectivity(samples, "province", ["ts", "event_id"]), gap_key="handle")
    line = lambda name, *parts: F.transform(name, lambda x: F.concat_ws(" ", *[x[p].cast("string") for p in parts])).alias(name)
    return out.select(
        "province", "period_start", "period_end", "total", "confirmed", "disputed", "fatalities", line("highlights", "event_id", "priority"),
        line("trends", "kind", "label", "current", "previous", "direction"), line("actors", "actor", "current", "previous"), line("gaps", "gap", "n", "detail"),
        line("connectivity", "province", "status", "run"),
    )


_ASKED = "Clash or shelling near province-3 by actor-7?"


@query(
    sql(
        f"""t(t) as (values ('clash'), ('shelling'), ('near'), ('province'), ('actor')),
h as (select event_id, ts, {unmark("concat_ws(' ', place, province, territory)")} as p, {unmark("array_to_string(actors, ' ')")} as a, {unmark("concat_ws(' ', event_type, description)")} as w from act),
s as (select event_id, ts, sum(3 * contains(p, t)::int + 3 * contains(a, t)::int + contains(w, t)::int) as score from h, t group by 1, 2),
n as (select count(*) as total, count(*) filter (ts >= {back(168)}) as recent, count(*) filter (ts < {back(168)} and ts >= {back(336)}) as previous from s where score > 0)
select event_id, cast(score as int) as score, total, recent, previous from s, n where score > 0 order by score desc, ts desc, event_id limit 5"""
    )
)
def related_events(spark, d):
    """Events that bear on a question."""
    return reports.related_events(ev(spark, d), _ASKED, NOW)


@query()
def evidence_brief(spark, d):
    """What the documents that answer a question best amount to as evidence."""
    rows = table(spark, d, "documents").selectExpr(
        "doc_id as id", "substr(coalesce(text, ''), 1, 60) as title", "array(coalesce(source, '')) as entities", "lang as meta", "text as body", "doc_id as updated_at",
        "case doc_id % 4 when 0 then 'verified' when 1 then 'draft' when 2 then 'disputed' else 'in_review' end as status",
        "case doc_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence", "doc_id % 3 as sources", "doc_id % 7 = 0 as illustrative",
    )
    return reports.brief(rows, "Which is the Apache license version, and zzyzx?")
