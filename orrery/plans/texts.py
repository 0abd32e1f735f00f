"""Queries over texts, records and anomalies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import dims
from ..functions import stats, text, times
from ..operators import anomaly, patterns, records
from .adapter import NOW, NOW_SQL, ev, rp, sql, table, values
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


def unmark(x: str) -> str:
    return f"translate(lower({x}), '{text.MARKED}', '{text.PLAIN}')"


def fold(x: str) -> str:
    apostrophes = f"regexp_replace({unmark(x)}, '[''’ʼ]', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({apostrophes}, '[^a-z0-9 \\t\\n\\v\\f\\r-]', ' ', 'g'), '[ \\t\\n\\v\\f\\r_-]+', ' ', 'g'))"


_DOCS = "d as (select doc_id, coalesce(text, '') as text, lang, source from documents)"


@query(f"with {_DOCS} select doc_id, {fold('text')} as folded from d")
def fold_key(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold_key(F.coalesce("text", F.lit(""))).alias("folded"))


def _marks(lang: str) -> str:
    return f"len(list_intersect(w, [{', '.join(repr(m) for m in text.LANGUAGE_MARKERS[lang])}])) - {1 if lang == 'ln' else 0}"


_N = {g: f"({_marks(g)})" for g in text.LANGUAGE_MARKERS}


@query(
    f"""with {_DOCS}, f as (select doc_id, list_distinct(string_split({fold('text')}, ' ')) as w from d),
n as (select doc_id, {', '.join(f'{x} as {g}' for g, x in _N.items())} from f)
select doc_id, case when greatest(fr, sw, ln, en) < 2 then 'unknown' when fr >= greatest(sw, ln, en) then 'fr' when sw >= greatest(ln, en) then 'sw' when ln >= en then 'ln' else 'en' end as language from n"""
)
def language_detect(spark, d):
    folded = text.fold_key(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", text.detect_language(text.tokens(folded)).alias("language"))


@query(
    f"""with {_DOCS}, f as (select doc_id, {fold("text")} as f from d),
g as (select doc_id, list_distinct(list_transform(range(1, len(f) + 1), lambda i: substr(' ' || f || ' ', i, 3))) as g from f)
select a.doc_id as a, b.doc_id as b, round(case when len(a.g) + len(b.g) = 0 then 0 else 2.0e0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) end, 6) as dice from g a join g b on b.doc_id = a.doc_id + 1"""
)
def trigram_dice_pairs(spark, d):
    """The similarity of neighbouring documents, over the trigrams of their whole texts."""
    g = table(spark, d, "documents").select("doc_id", text.trigrams(text.fold_key(F.coalesce("text", F.lit("")))).alias("g"))
    x = g.select(F.col("doc_id").alias("a"), F.col("g").alias("ga")).join(g.select(F.col("doc_id").alias("b"), (F.col("doc_id") - 1).alias("a"), F.col("g").alias("gb")), "a")
    return x.select("a", "b", F.round(text.dice(F.col("ga"), F.col("gb")), 6).alias("dice"))


@query()
def trigram_dice_texts(spark, d):
    """The same by trigrams as numbers."""
    g = table(spark, d, "documents").select("doc_id", text.trigram_codes(text.fold_key(F.coalesce("text", F.lit("")))).alias("g"))
    x = g.select(F.col("doc_id").alias("a"), F.col("g").alias("ga")).join(g.select(F.col("doc_id").alias("b"), (F.col("doc_id") - 1).alias("a"), F.col("g").alias("gb")), "a")
    return x.select("a", "b", F.round(text.dice(F.col("ga"), F.col("gb")), 6).alias("dice"))


@query(
    r"""select page_id, case when regexp_matches(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+')
    then regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)), '^www\.', '') else '' end as host from pages"""
)
def url_host_source(spark, d):
    return table(spark, d, "pages").select("page_id", text.host_of(F.col("url")).alias("host"))


@query()
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query()
def certainty(spark, d):
    c = text.certainty(text.fold_key(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", c["level"].alias("level"), c["cue"].alias("cue"))


@query()
def summaries(spark, d):
    return table(spark, d, "documents").select("doc_id", text.summarise(F.coalesce("text", F.lit(""))).alias("summary"))


@query()
def time_resolution(spark, d):
    """What the turns of conversations say of their time, against a fixed day."""
    # A text is folded once, and its time resolved once: inlined, it would be folded anew for each cue that is sought.
    x = table(spark, d, "conversations").select("conv_id", "turn", text.fold_key(F.coalesce("text", F.lit(""))).alias("folded"))
    x = x.withColumn("words", text.tokens(F.col("folded")))
    x = x.withColumn("t", times.resolve_time(F.col("folded"), F.col("words"), F.lit(NOW).cast("timestamp_ntz")))
    return x.select("conv_id", "turn", F.col("t.ts").alias("ts"), F.col("t.uncertainty_min").alias("uncertainty_min"))


@query(
    """select conv_id, count(*) as turns, count(*) filter (role = 'user') as asked, max(turn) - min(turn) + 1 as span,
    cast(sum(len(coalesce(text, ''))) as bigint) as chars from conversations group by 1"""
)
def conversation_windows(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), (F.max("turn") - F.min("turn") + 1).alias("span"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"),
    )


@query(
    sql(
        """select event_id, j, case agreement when 'contradict' then 5 when 'agree' then case when n >= 3 then 2 when n = 2 then 3 else 4 end else case when n >= 3 then 3 else 4 end end as credibility
from (select event_id, j, agreement, (event_id % 4 <> 0)::int + ((event_id + j) % 3 <> 0)::int + (j <> 1)::int as n from rp)"""
    )
)
def grade_credibility(spark, d):
    certainty_of = F.when(F.col("agreement") == "contradict", "denied").when(F.col("agreement") == "agree", "asserted").otherwise("attributed")
    c = stats.credibility_of(certainty_of, F.col("event_id") % 4 != 0, (F.col("event_id") + F.col("j")) % 3 != 0, F.col("j") != 1)
    return rp(spark, d).select("event_id", F.col("j").cast("long").alias("j"), c.alias("credibility"))


_SECTORS = ["src0", "src1", "src2", "src3"]
#: Columns of a record over documents, the same text in both engines.
_REC = {
    "title": "substr(text, 1, cast(doc_id % 160 as int))",
    "sector": "source",
    "country": "case when doc_id % 9 <> 0 then lang else ' ' end",
    "summary": "substr(text, 1, cast(doc_id % 50 as int))",
    "lat": "case when doc_id % 7 <> 0 then doc_id % 120 * 1.0e0 end",
    "lon": "case when doc_id % 11 <> 0 then doc_id % 200 * 1.0e0 end",
    "status": "case doc_id % 5 when 0 then 'verified' when 1 then 'in_review' when 2 then 'draft' when 3 then 'disputed' else 'archived' end",
    "confidence": "case doc_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end",
    "sources": "doc_id % 4",
}
_REC_SQL = f"{_DOCS}, r as (select doc_id, {', '.join(f'{x} as {c}' for c, x in _REC.items())} from d)"


def _records(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.selectExpr("doc_id", *[f"{x} as {c}" for c, x in _REC.items()])


@query(
    f"""with {_REC_SQL}, e as (select doc_id, [case when len(trim(title)) < 8 or len(trim(title)) > 140 then 'title' end,
    case when not coalesce(sector in ({', '.join(map(repr, _SECTORS))}), false) then 'sector' end, case when trim(country) = '' then 'country' end,
    case when len(trim(summary)) < 20 then 'summary' end,
    case when (lat is null) <> (lon is null) or coalesce(not lat between -90 and 90, false) or coalesce(not lon between -180 and 180, false) then 'coords' end,
    case when status in ('verified', 'in_review') and sources = 0 then 'status' end, case when confidence = 'high' and sources < 2 then 'confidence' end] as e from r)
select doc_id, coalesce(array_to_string(list_filter(e, lambda x: x is not null), ','), '') as errors from e"""
)
def record_validation(spark, d):
    e = records.record_errors(*[F.col(c) for c in ("title", "sector", "country", "summary", "lat", "lon", "status", "confidence", "sources")], _SECTORS)
    return _records(spark, d).select("doc_id", F.array_join(e, ",").alias("errors"))


@query(
    f"""with {_REC_SQL} select doc_id, case when status = 'archived' then 0 else least(100, case sources when 0 then 35 when 1 then 15 else 0 end
    + case status when 'disputed' then 30 when 'draft' then 15 when 'in_review' then 10 else 0 end + case confidence when 'low' then 15 when 'medium' then 5 else 0 end
    + case when doc_id % 300 > 180 then 20 when doc_id % 300 > 60 then 10 else 0 end + case when doc_id % 6 > 3 then 5 else 0 end + case when coalesce(toxic, 0) > 0 then 10 else 0 end
    + case when quality = 0 then 10 else 0 end) end as score from r left join labels using (doc_id)"""
)
def attention_index(spark, d):
    rows = _records(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    score = records.attention(
        F.col("status"), F.col("confidence"), F.col("sources"), F.greatest(F.lit(0), F.col("doc_id") % 6 - 3), F.coalesce("toxic", F.lit(0)), F.col("doc_id") % 300,
        F.coalesce(F.col("quality") == 0, F.lit(False)),
    )
    return rows.select("doc_id", score.alias("score"))


@query(f"""with {_REC_SQL}, h as (select doc_id, status, {unmark("concat_ws(' ', text, lang, source, concat('Digest of ', source), concat('House of ', lang))")} as hay from d join r using (doc_id))
select doc_id, status from h where status <> 'archived' and contains(hay, 'license') and contains(hay, 'digest') and contains(hay, 'house')""")
def record_search(spark, d):
    """Records that are not archived and hold three words, of which two stand in their nested sources alone."""
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select(
        "doc_id", none.alias("title"), F.col("text").alias("summary"), F.col("lang").alias("country"), none.alias("region"), F.col("source").alias("sector"), F.expr(_REC["status"]).alias("status"),
        F.array("source", none).alias("entities"), F.array(F.struct(F.concat(F.lit("Digest of "), "source").alias("title"), F.concat(F.lit("House of "), "lang").alias("publisher"))).alias("sources"),
    )
    return docs.where(records.selected("  LICENSE dïgest House license ")).select("doc_id", "status")


@query(
    f"""with {_DOCS}, h as (select doc_id, {unmark("substr(text, 1, 60)")} as title, {unmark("coalesce(source, '')")} as ents, {unmark("coalesce(lang, '')")} as meta, {unmark('text')} as body from d),
t(t) as (values ('license'), ('apache'), ('version')),
s as (select doc_id, sum(case when contains(title, t) then 3 else 0 end + case when contains(ents, t) then 3 else 0 end + case when contains(meta, t) then 2 else 0 end
    + case when contains(body, t) then 1 else 0 end) as score from h, t group by 1)
select doc_id, cast(score as int) as score from s where score > 0 order by score desc, doc_id desc limit 6"""
)
def keyword_retrieval(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"), F.array(F.coalesce("source", F.lit(""))).alias("entities"),
        F.col("lang").alias("meta"), F.col("text").alias("body"), F.col("doc_id").alias("updated_at"),
    )
    return records.retrieve(rows, "Which is the Apache license version?").select(F.col("id").alias("doc_id"), "score").where("score > 0")


@query(
    """with m as (select distinct l_orderkey as r, p_brand as e from lineitem join part on l_partkey = p_partkey)
select x.e as a, y.e as b, count(*) as shared from m x join m y using (r) where x.e < y.e group by 1, 2"""
)
def entity_cooccurrence(spark, d):
    m = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return records.cooccurrence(m, "l_orderkey", "p_brand")


@query(
    f"""with recursive h as (select event_type, date_trunc('hour', ts) as ts, sum(value) as v from events where value is not null group by all),
s as (select *, hour(ts) + case when dayofweek(ts) in (0, 6) then 24 else 0 end as b from h), k as (select *, row_number() over (partition by event_type, b order by ts, v) as i from s),
f as (
    select event_type, b, i, ts, v, v as level, greatest(1e-6, abs(v) * 0.12e0) as scale, 0.0e0 as expected, 0.0e0 as z, false as hit from k where i = 1
    union all
    select event_type, b, i, ts, v, level + r * {anomaly.LEVEL}e0 * (v - level), scale + r * {anomaly.SCALE}e0 * (abs(v - level) - scale), level, z, hit
    from (
        select *, case when hit then {anomaly.DAMPED}e0 else 1.0e0 end as r
        from (select *, i > {anomaly.LEAST} and abs(z) >= {anomaly.THRESHOLD}e0 as hit
            from (select k.*, f.level, f.scale, (k.v - f.level) / greatest(f.scale, abs(f.level) * 0.03e0, 1e-6) as z from f join k on k.event_type = f.event_type and k.b = f.b and k.i = f.i + 1))
    )
)
select event_type, ts, round(v, 4) as value, round(expected, 4) as expected, round(z, 4) as z, case when z < 0 then 'drop' else 'spike' end as direction,
    round(least(0.99e0, 0.5e0 + 0.5e0 * (1 - exp(-(abs(z) - {anomaly.THRESHOLD}e0) / {anomaly.THRESHOLD}e0))), 4) as score from f where hit"""
)
def seasonal_hits(spark, d):
    hourly = table(spark, d, "events").groupBy("event_type", F.date_trunc("HOUR", F.col("ts")).cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("value"))
    hits = anomaly.seasonal_hits(hourly, "event_type")
    return hits.select("event_type", "ts", "direction", *[F.round(c, 4).alias(c) for c in ("value", "expected", "z", "score")])


def _scanned(spark, d):
    return anomaly.cylinders(ev(spark, d).withColumn("weight", F.col("confidence")), F.lit(NOW).cast("timestamp_ntz"))


_PLACES = f"places(name, la, lo) as (values {values([p[:3] for p in dims.PLACES])})"


@query(
    sql(
        f"""{_PLACES}, h as (select lat, lon, confidence as w, (epoch({NOW_SQL}) - epoch(ts)) / 3600.0e0 as h from ev),
x as (select * from h where h >= 0 and h < 720), k as (select name as centre, w, h, {km('lat', 'lon', 'la', 'lo')} as km from x, places),
r(radius_km) as (values (8), (15), (25), (40)), v(hours) as (values (24), (72), (168)),
t as (select hours, sum(w) filter (h < hours) as total, sum(w) filter (h >= 168) as before from x, v group by 1),
c as (select centre, radius_km, hours, coalesce(sum(w) filter (km <= radius_km and h < hours), 0) as obs, coalesce(sum(w) filter (km <= radius_km and h >= 168), 0) as b
    from k, r, v where centre in (select centre from k where km <= 40) group by all),
e as (select *, (b + 0.5e0) / (before + 1) * total as exp from c join t using (hours))
select centre, radius_km, hours, round(obs, 6) as observed, round(exp, 6) as expected, round(case when obs >= 3 and obs > exp and exp > 0
    then obs * ln(obs / exp) + case when total - obs > 0 and total - exp > 0 then (total - obs) * ln((total - obs) / (total - exp)) else 0 end else 0 end, 6) as llr from e"""
    )
)
def scan_observed_llr(spark, d):
    return _scanned(spark, d).select("centre", "radius_km", "hours", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "llr")])


@query()
def scan_pvalues(spark, d):
    return anomaly.scan(_scanned(spark, d))


@query()
def source_validation(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "substr(html, 1, 5) as t", "'press' as pub", "url", "case when page_id % 3 = 0 then '2024-02-30' end as published", "'2024-01-20' as retrieved")
    e = records.source_errors(*[F.col(c) for c in ("t", "pub", "url", "published", "retrieved")], date(2024, 1, 31))
    return p.select("page_id", F.array_join(e, ",").alias("errors"))


def _any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


#: A report's text in both engines: a document with a dateline before it, of which some name the region.
_DATED = "concat(case doc_id % 7 when 0 then 'GOMA: ' when 1 then 'Kasaï-Oriental, ' when 2 then 'Lyon, ' when 3 then 'Les Maï-Maï, ' when 4 then 'CODECO; ' else '' end, coalesce(text, ''))"


@query(
    f"""with d as (select doc_id, {_DATED} as text from documents), r as (select doc_id, {_any("lower(text)", patterns.RELEVANT)} as browsed, {_any(unmark('text'), patterns.RELEVANT_COLLECTED)} as collected from d)
select * from r where browsed or collected"""
)
def relevant_reports(spark, d):
    """Whole texts that name the region, by either list of words."""
    x = F.expr(_DATED)
    rows = table(spark, d, "documents").select("doc_id", patterns.relevant(F.lower(x)).alias("browsed"), patterns.relevant(text.unmark(x), patterns.RELEVANT_COLLECTED).alias("collected"))
    return rows.where("browsed or collected")
