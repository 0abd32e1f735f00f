"""Queries from raw reports: extraction, normalisation, adjudication."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text, times
from ..operators import adjudicate as decisions
from ..operators import extract as ex
from .adapter import NOW, NOW_SQL, ev, rp, sql, table, values
from .texts import fold
from .typed import CLASSES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _case(n: int, parts: list[str]) -> str:
    return f"case event_id % {n} " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(parts) if p) + " else '' end"


_WHERE = [p[0] for p in dims.PLACES[:9]] + ["Amaro Ville", "Esker Nord", "Beltanne", "Eastmark", "Kestle, Westvale"]
#: Columns of a raw report over events, the same text in both engines.
_RAW = {
    "event_id": "event_id",
    "text": "concat("
    + ", ".join(
        [
            _case(6, ["Affrontements à ", "Shelling near ", "Incendie vers ", "Marche pacifique dans ", "Bulletin de ", "Enlèvement à "]),
            _case(15, _WHERE),
            _case(7, [" par la Colonne Grise", " entre Third Brigade et River Guard", " malgré Blue Mission", " des fermiers"]),
            _case(8, [", douze civils tués", ", morts au nombre de 7 et 3 blessés", ", des centaines de déplacés", ", 15 wounded, 2 killed", ", deux otages"]),
            _case(5, [" hier", " ce matin vers 05h30", " il y a deux heures", " mardi"]),
            _case(4, [". Selon des témoins", ". La garde dément", ". Le bilan serait lourd"]),
        ]
    )
    + ")",
    "created_at": "ts",
    "source_id": "concat('src:', event_id)",
    "t": "user_id % 28",
    "handle": "case when user_id % 3 <> 0 then concat('@u', user_id % 40) end",
    "lang": "case when event_id % 9 = 0 then 'fr' end",
    "geo_lat": "case when event_id % 10 = 0 then -1.5e0 + (event_id % 50) / 100.0e0 end",
    "geo_lon": "case when event_id % 10 = 0 then 29.1e0 end",
    "geo_radius_km": "case when event_id % 20 = 0 then 2.5e0 end",
}
_TYPES = [(i, p[0]) for i, p in enumerate(dims.SOURCE_PROFILES)] + [(len(dims.SOURCE_PROFILES), "unlisted")]


def raw(spark, d):
    types = spark.createDataFrame(_TYPES, "t long, source_type string")
    rows = table(spark, d, "events").selectExpr(*[f"{x} as {c}" for c, x in _RAW.items()])
    return rows.join(F.broadcast(types), "t").withColumn("url", F.lit(None).cast("string"))


def when_sql(f: str, base: str) -> tuple[str, str]:
    """The time that a folded text states, and its uncertainty."""
    age = r"il y a (\d+|un|une|deux|trois|quatre|cinq|six|sept)\s+(minutes?|heures?|jours?)"
    clock = r"(\d{1,2})\s*(?:h|:)\s*(\d{2})?"
    n, unit_word = (f"regexp_extract({f}, '{age}', {i})" for i in (1, 2))
    number = f"case {n} " + " ".join(f"when '{k}' then {v}" for k, v in times.SMALL_NUMBERS.items()) + f" else try_cast({n} as int) end"
    unit = f"case when starts_with({unit_word}, 'minute') then 1 when starts_with({unit_word}, 'heure') then 60 else 1440 end"
    hh, mm = f"try_cast(regexp_extract({f}, '{clock}', 1) as int)", f"coalesce(try_cast(regexp_extract({f}, '{clock}', 2) as int), 0)"
    has = f"coalesce({hh} <= 23 and {mm} <= 59, false)"
    pinned = lambda t: f"(date_trunc('day', {t}) + to_minutes({hh} * 60 + {mm}))"
    parts = [(f"{n} <> ''", f"{base} - to_minutes(({number}) * ({unit}))", f"case {unit} when 1 then 10 when 60 then 45 else 360 end")]
    for cues, offset, spread in times.TIME_CUES:
        hit = " or ".join(f"contains({f}, '{c}')" for c in cues)
        t = f"({base} + to_minutes({offset}))"
        parts += [(f"({hit}) and {has}", pinned(t), "45"), (f"({hit})", t, str(spread))]
    for i, day in enumerate(times.WEEKDAYS):
        back = f"(dayofweek({base}) - {i} + 7) % 7"
        parts.append((f"list_contains(string_split({f}, ' '), '{day}')", f"{base} - to_days(cast(case when {back} = 0 then 7 else {back} end as int))", "720"))
    parts.append((has, f"case when {pinned(base)} > {base} then {pinned(base)} - to_days(1) else {pinned(base)} end", "60"))
    return tuple("case " + " ".join(f"when {p[0]} then {p[i]}" for p in parts) + " end" for i in (1, 2))


def cue_sql(f: str, cues: list[str]) -> str:
    return "coalesce(" + ", ".join(f"case when contains({f}, '{c}') then '{c}' end" for c in cues) + ")"


def level_sql(f: str) -> str:
    kinds = {"denied": text.DENIAL, "hedged": text.HEDGE, "attributed": text.ATTRIBUTION}
    return "case " + " ".join(f"when {cue_sql(f, cues)} is not null then '{k}'" for k, cues in kinds.items()) + " else 'asserted' end"


def any_cue_sql(f: str) -> str:
    return f"coalesce({', '.join(cue_sql(f, cues) for cues in (text.DENIAL, text.HEDGE, text.ATTRIBUTION))})"


def language_sql(words: str) -> str:
    n = {g: f"(len(list_intersect(list_distinct({words}), [{', '.join(repr(m) for m in ms)}])) - {1 if g == 'ln' else 0})" for g, ms in text.LANGUAGE_MARKERS.items()}
    fr, sw, ln, en = (n[g] for g in ("fr", "sw", "ln", "en"))
    return f"case when greatest({fr}, {sw}, {ln}, {en}) < 2 then 'unknown' when {fr} >= greatest({sw}, {ln}, {en}) then 'fr' when {sw} >= greatest({ln}, {en}) then 'sw' when {ln} >= {en} then 'ln' else 'en' end"


def _folded(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def _keys(entities: list[tuple[str, list[str]]]) -> str:
    return values([(i, n, _folded(k), len(_folded(k).split())) for i, (name, others) in enumerate(entities) for n, k in enumerate([name, *others])])


_PLACE_KEYS = _keys([(p[0], p[7]) for p in dims.PLACES] + [(p[0], []) for p in dims.PROVINCES])
_ACTOR_KEYS = _keys([(a[0], a[3]) for a in dims.ACTORS])
_GAZETTEER = values([(i, p[0], p[1], p[2], float(p[4]), p[5], p[6]) for i, p in enumerate(dims.PLACES)] + [(len(dims.PLACES) + i, n, la, lo, r, "province", n) for i, (n, la, lo, r) in enumerate(dims.PROVINCES)])
_NUMBERS = "case " + " ".join(f"when w = '{k}' then {v}" for k, v in ex.NUMERALS.items()) + " when regexp_full_match(w, '[0-9]+') then try_cast(w as bigint) end"


def _scan(name: str, keys: str) -> str:
    """Matches of a dictionary whose phrases have three words at most and never overlap: (event_id, pos, till, ord, score, phrase)."""
    return f"""{name}_k(ord, n, key, span) as (values {keys}), {name}_own as (select key, span, min(ord) as ord from {name}_k group by 1, 2),
{name}_x as (select event_id, i as pos, i + span as till, ord, 1.0e0 as score, key as phrase from w join {name}_own on array_to_string(ws[i + 1:i + span], ' ') = key and i + span <= len(ws)),
{name}_m as (select * from {name}_x a where till - pos > 1 or not exists (select 1 from {name}_x b where b.event_id = a.event_id and b.till - b.pos > 1 and b.pos <= a.pos and a.pos < b.till)),
{name}_d as (select word, case when len(word) < 5 then 0 when len(word) <= 8 then 1 else 2 end as most from (select distinct w as word from w) where word not in (select key from {name}_own)),
{name}_p as (select distinct substr(key, 1, 1) as letter, ord from {name}_k),
{name}_e as (select word, min(struct_pack(d := damerau_levenshtein(word, key), o := k.ord, n := n)) as m from {name}_d join {name}_p p on p.letter = substr(word, 1, 1) join {name}_k k on k.ord = p.ord and not contains(k.key, ' ')
    and abs(len(key) - len(word)) <= most where most > 0 and damerau_levenshtein(word, key) <= most group by 1),
{name} as (select * from {name}_m union all select event_id, i, i + 1, m.o, 1 - 0.2e0 * m.d, w from w join {name}_e on w.w = word
    where not exists (select 1 from {name}_m b where b.event_id = w.event_id and b.pos <= i and i < b.till))"""


_WHEN, _SPREAD = when_sql("f", "created_at")
_FIELDS = {k: ", ".join(f"'{c}'" for c in v) for k, v in ex.CASUALTY_CUES.items()}
_NEAR = "coalesce(" + ", ".join(f"case when i + {k} >= 0 then ns[i + {k} + 1] end" for k in [-1, -2, -3, -4, 1, 2, 3]) + ")"
_EXTRACTED = f"""types(t, source_type) as (values {values(_TYPES)}),
raw0 as (select {', '.join(f'{x} as {c}' for c, x in _RAW.items())} from events),
raw as (select *, list_filter(string_split(f, ' '), lambda x: x <> '') as ws from (select *, {fold('text')} as f from raw0 join types using (t))),
w0 as (select event_id, ws, unnest(range(0, len(ws))) as i from raw), w as (select *, ws[i + 1] as w from w0),
{_scan('pl', _PLACE_KEYS)}, {_scan('ac', _ACTOR_KEYS)},
gaz(ord, name, lat, lon, radius, kind, province) as (values {_GAZETTEER}),
spot as (select event_id, lat, lon, name as place, radius * case when score < 1 then {ex.MISSPELT}e0 else 1.0e0 end as radius_km, case when kind = 'province' then 'admin_centroid' else 'gazetteer' end as method, province
    from pl join gaz using (ord) qualify row_number() over (partition by event_id order by kind = 'province', case when kind = 'province' then 0 else -score end, case when kind = 'province' then 0 else radius end, pos) = 1),
pt as (select event_id, arg_min(phrase, pos) as place_text from pl group by 1),
who0 as (select event_id, ord, min(pos) as pos, arg_min(phrase, pos) as phrase from ac group by 1, 2), nm(ord, name) as (values {values([(i, a[0]) for i, a in enumerate(dims.ACTORS)])}),
who as (select event_id, list(name order by pos) as actors, arg_min(phrase, pos) as actor_text from who0 join nm using (ord) group by 1),
num as (select event_id, list({_NUMBERS} order by i) as ns from w group by 1),
cas as (select event_id, {', '.join(f"max(n) filter (w in ({cues})) as {k}" for k, cues in _FIELDS.items())} from (select event_id, w, {_NEAR} as n from w join num using (event_id)) group by 1),
exd as (select r.event_id, f, ws, source_id, source_type, handle, created_at, lang, geo_lat, geo_lon, geo_radius_km, spot.* exclude (event_id), place_text, coalesce(actors, []) as actors, actor_text, fatalities, injured, abducted, displaced,
    {_WHEN} as stated, {_SPREAD} as spread, {level_sql('f')} as certainty, {any_cue_sql('f')} as cue, {language_sql('ws')} as language
    from raw r left join spot using (event_id) left join pt using (event_id) left join who using (event_id) left join cas using (event_id))"""


@query(
    sql(
        f"""{_EXTRACTED} select event_id, place, radius_km, method, place_text, array_to_string(actors, ',') as actors, fatalities, injured, abducted, displaced, stated, spread as uncertainty_min, certainty, cue, language from exd"""
    )
)
def extracted_reports(spark, d):
    """What the texts of raw reports say."""
    x = ex.extract(raw(spark, d))
    return x.select(
        "event_id", "location.place", "location.radius_km", "location.method", "place_text", F.array_join("actors", ",").alias("actors"), "fatalities", "injured", "abducted", "displaced",
        F.col("when.ts").alias("stated"), F.col("when.uncertainty_min").alias("uncertainty_min"), "certainty", "cue", "language",
    )


#: Observations of sources over events.
_SEEN = "case when event_id % 3 = 0 then source_type else concat_ws(':', source_type, case when user_id % 3 <> 0 then concat('@u', user_id % 40) end) end as key, value > 20 as correct, cast(1 + event_id % 3 as double) as weight, ts as at"


def _observations(spark, d):
    types = spark.createDataFrame(_TYPES, "t long, source_type string")
    return table(spark, d, "events").withColumn("t", F.col("user_id") % 28).join(F.broadcast(types), "t").selectExpr(*[x.strip() for x in _split(_SEEN)])


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


_P = "case grade " + " ".join(f"when '{k}' then {v}e0" for k, v in dims.GRADE_P.items()) + " end"
_KM = "2 * 6371.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians(lat - geo_lat) / 2), 2) + cos(radians(geo_lat)) * cos(radians(lat)) * pow(sin(radians(lon - geo_lon) / 2), 2))))"
_DEFAULT = next(p for p in dims.SOURCE_PROFILES if p[0] == dims.DEFAULT_SOURCE)


@query(
    sql(
        f"""{_EXTRACTED}, said as (select event_id, f, actors as who, coalesce(fatalities, 0) as dead, coalesce(displaced, 0) as moved, coalesce(abducted, 0) as taken, coalesce(injured, 0) as hurt from exd), {CLASSES},
prof(source_type, family, grade, credibility, strength) as (values {values(dims.SOURCE_PROFILES)}),
src as (select distinct source_type, coalesce(handle, '') as handle from exd),
full0 as (select src.*, coalesce(family, '{_DEFAULT[1]}') as family, coalesce(grade, '{_DEFAULT[2]}') as grade, coalesce(strength, {_DEFAULT[4]}) as strength from src left join prof using (source_type)),
obs as (select {_SEEN.replace(' as at', ' as seen_at')} from (select *, user_id % 28 as t from events) join types using (t)),
ow as (select *, weight * pow(0.5e0, greatest(0, epoch({NOW_SQL}) - epoch(seen_at)) / 86400.0e0 / 90.0e0) as dw from obs),
oa as (select f.source_type, f.handle, coalesce(sum(dw) filter (correct), 0) as sa, coalesce(sum(dw) filter (not correct), 0) as sb from full0 f join ow on key = f.source_type or (f.handle <> '' and key = f.source_type || ':' || f.handle) group by 1, 2),
post as (select f.*, ({_P} * strength + coalesce(sa, 0)) / (strength + coalesce(sa, 0) + coalesce(sb, 0)) as mean from full0 f left join oa using (source_type, handle)),
near as (select event_id, arg_min(name, {_KM}) filter ({_KM} <= 30) as name from exd, (select ord, name, lat, lon from gaz where kind <> 'province') g group by 1)
select e.source_id, e.source_type, family, case when mean >= 0.9e0 then 'A' when mean >= 0.75e0 then 'B' when mean >= 0.58e0 then 'C' when mean >= 0.33e0 then 'D' when mean >= 0.1e0 then 'E' else 'F' end as source_grade,
    round(mean, 3) as prior, coalesce(stated, created_at) as ts, coalesce(spread, 120) as time_uncertainty_min, case when geo_lat is null then place else coalesce(near.name, 'raw coordinates') end as place,
    case when geo_lat is null then radius_km else coalesce(geo_radius_km, 1.0e0) end as radius_km, case when geo_lat is null then method else 'exact' end as method, coalesce(kind, 'unknown') as event_type,
    array_to_string(actors, ',') as actors, fatalities, coalesce(lang, language) as language, certainty, coalesce(place_text, actor_text) as matched_span,
    case when certainty = 'denied' then 5 when certainty = 'asserted' then case when c >= 3 then 2 when c = 2 then 3 else 4 end when certainty = 'attributed' then case when c >= 3 then 3 else 4 end else case when c >= 2 then 4 else 5 end end as credibility,
    round(mean * case when coalesce(share, 0) > 0 then share else {ex.UNSCORED}e0 end, 3) as report_confidence, case when certainty = 'denied' then 'contradict' else 'agree' end as agreement
from (select *, (place is not null or geo_lat is not null)::int + (len(actors) > 0)::int + (stated is not null)::int as c from exd) e left join t using (event_id) left join near using (event_id)
    join post on post.source_type = e.source_type and post.handle = coalesce(e.handle, '') where place is not null or geo_lat is not null or kind is not null""".replace("lat - geo_lat", "g.lat - geo_lat").replace("radians(lat)", "radians(g.lat)").replace("lon - geo_lon", "g.lon - geo_lon").replace("arg_min(name,", "arg_min(g.name,")
    )
)
def normalised_reports(spark, d):
    """Raw reports as events."""
    x = ex.normalise(raw(spark, d), _observations(spark, d), NOW)
    return x.select(
        "source_id", "source_type", "family", "source_grade", "prior", "ts", "time_uncertainty_min", "place", "radius_km", "method", "event_type", F.array_join("actors", ",").alias("actors"), "fatalities", "language",
        "certainty", "matched_span", "credibility", "report_confidence", "agreement",
    )


_DECIDED = "event_id, decision as action, case when event_id % 2 = 0 then 'ana' else 'bo' end as analyst, ts as at"


@query(
    sql(
        """d as (select event_id, decision as action, ts as seen_at from ev where decision in ('confirm', 'reject')),
o as (select source_type, concat('@', source_type, event_id % 3) as handle, (action = 'confirm') <> (agreement = 'contradict') as correct, case when agreement = 'partial' then 0.5e0 else 1.0e0 end as weight, seen_at from d join rp using (event_id)),
k as (select source_type as key, * from o union all select source_type || ':' || handle, * from o)
select key, count(*) as n, count(*) filter (correct) as correct, sum(weight) as weight from (select * from k qualify row_number() over (partition by key order by seen_at desc) <= 500) group by 1"""
    )
)
def adjudicated_sources(spark, d):
    """What decisions on events teach of their sources."""
    decided = ev(spark, d).where("decision is not null").selectExpr(*[x.strip() for x in _split(_DECIDED)])
    reports = rp(spark, d).withColumn("handle", F.concat(F.lit("@"), "source_type", F.col("event_id") % 3))
    seen = decisions.observe(decisions.credits(decided, reports))
    return seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.sum("weight").alias("weight"))





@query(
    sql(
        """m as (select event_id as into_id, event_id - 1 as event_id from ev where event_id % 10 = 7)
select event_id, coalesce(into_id, event_id) as published_as, case when into_id is not null then 'merged' else status end as status, coalesce(n, 0) as reports from ev left join m using (event_id)
left join (select coalesce(into_id, event_id) as event_id, count(*) as n from rp left join m using (event_id) group by 1) using (event_id)"""
    )
)
def merged_by_hand(spark, d):
    """Events after merges by hand: the merged ones give their reports away."""
    merges = ev(spark, d).where("event_id % 10 = 7").select("event_id", (F.col("event_id") - 1).alias("other_id"))
    events, reports = decisions.merge(ev(spark, d).select("event_id", "status"), rp(spark, d).select("event_id", "j"), merges)
    n = reports.groupBy("event_id").agg(F.count(F.lit(1)).alias("reports"))
    return events.join(n, "event_id", "left").select("event_id", "published_as", "status", F.coalesce("reports", F.lit(0)).alias("reports"))


# SQL of queries in texts.py, from the expressions above.
_FOLDED_DOCS = f"f as (select doc_id, {fold("coalesce(text, '')")} as f from documents)"
ORACLES["certainty"] = f"with {_FOLDED_DOCS} select doc_id, {level_sql('f')} as level, {any_cue_sql('f')} as cue from f"
_TURN_WHEN, _TURN_SPREAD = when_sql("f", NOW_SQL)
ORACLES["time_resolution"] = f"""with f as (select conv_id, turn, {fold("coalesce(text, '')")} as f from conversations)
select conv_id, turn, {_TURN_WHEN} as ts, {_TURN_SPREAD} as uncertainty_min from f"""
