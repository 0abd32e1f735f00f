"""From a raw report to an event: places, actors, casualties, time and certainty of a text, and what they make of it.

Names are found by joins with dictionaries (``scanner``), once for each different text; all else is column expressions.
Defined results: a null or empty text names nothing, is of no known language, asserted, and of type ``unknown``; equal
texts are scanned once; reports keep their rows, whatever repeats; a source type without a profile has the default one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.stats import credibility_of
from ..functions.text import certainty, detect_language, fold_key, summarise, tokens
from ..functions.times import at_stated, stated_time
from ..storage import cut
from .classify import classified
from .fusion import posterior_of_sums
from .scanner import longest_matches
from .series import decayed
from .spatial import settlement_at

# Words for numbers in three languages.
NUMERALS = {
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12,
    "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16, "vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "cent": 100,
    "cents": 100, "mille": 1000, "milliers": 1000, "dizaines": 10, "centaines": 100,
    "moja": 1, "mbili": 2, "tatu": 3, "nne": 4, "tano": 5, "sita": 6, "saba": 7, "nane": 8, "tisa": 9, "kumi": 10, "ishirini": 20, "thelathini": 30,
    "hamsini": 50, "mia": 100, "elfu": 1000,
    "moko": 1, "mibale": 2, "misato": 3, "minei": 4, "mitano": 5, "zomi": 10, "nkama": 100, "nkoto": 1000,
}
# Words that say what a number counts.
CASUALTY_CUES = {
    "fatalities": [
        "morts", "mort", "tues", "tue", "tuees", "decedes", "deces", "victimes", "cadavres", "peris", "abattus", "wamekufa", "waliouawa", "waliokufa", "marehemu",
        "bakufi", "bawei", "killed", "dead", "fatalities",
    ],
    "injured": ["blesses", "blesse", "blessees", "wounded", "injured", "majeruhi", "waliojeruhiwa", "bazoki"],
    "abducted": ["enleves", "enleve", "enlevees", "kidnappes", "otages", "abducted", "kidnapped", "waliotekwa", "watekwa"],
    "displaced": ["deplaces", "deplace", "deplacees", "refugies", "fuient", "fui", "displaced", "wakimbizi", "waliokimbia", "bakimi"],
}
# Words before and after a cue among which its number is sought; widening of a place that was misspelt;
# minutes of uncertainty without a time; reach of a settlement's name in km; a report's share without a score.
BEFORE, AFTER, MISSPELT, UNTIMED_MIN, NAMED_KM, UNSCORED = 4, 3, 1.5, 120, 30.0, 0.4


def numeral(word: Column) -> Column:
    """The number that a folded word is, in digits or in letters; null for others."""
    words = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    return F.coalesce(F.when(F.regexp_like(word, F.lit("^[0-9]+$")), word.try_cast("bigint")), F.try_element_at(words, word).cast("bigint"))


def casualties(words: Column, numbers: Column) -> dict[str, Column]:
    """By field, the largest number that stands before a cue (the nearest of four words), or else after it (of three).
    ``words``: folded; ``numbers``: their ``numeral``s."""
    steps = [-i for i in range(1, BEFORE + 1)] + list(range(1, AFTER + 1))
    near = lambda i: F.coalesce(*[F.when(i + k >= 0, F.get(numbers, i + k)) for k in steps])
    out = {}
    for name, cues in CASUALTY_CUES.items():
        at = F.transform(words, lambda w, i: F.when(w.isin(*cues), near(i)))  # noqa: B023
        out[name] = F.array_max(at)
    return out


def dictionary(spark: SparkSession, entities: list[tuple[str, list[str]]]) -> DataFrame:
    """ord, n, key: the folded names of entities, as ``scanner`` takes them."""
    rows = [(i, n, k) for i, (name, others) in enumerate(entities) for n, k in enumerate([name, *others])]
    return spark.createDataFrame(rows, "ord long, n long, key string").withColumn("key", fold_key(F.col("key")))


def gazetteer(spark: SparkSession) -> DataFrame:
    """ord and what is known of a place: settlements, then provinces."""
    rows = [(i, p[0], p[1], p[2], float(p[4]), p[5], p[6]) for i, p in enumerate(dims.PLACES)]
    rows += [(len(rows) + i, name, la, lo, r, "province", name) for i, (name, la, lo, r) in enumerate(dims.PROVINCES)]
    return spark.createDataFrame(rows, "ord long, name string, lat double, lon double, radius_km double, kind string, province string")


def located(matches: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """key and the place of a text: of settlements the surest match, then the smallest, then the first; without one the
    first place. ``matches``: key, ord, start, score, phrase. A misspelt place is wider."""
    x = matches.join(F.broadcast(places), "ord")
    broad = F.col("kind").isin("province", "feature")
    order = F.struct(broad.alias("b"), F.when(broad, 0.0).otherwise(-F.col("score")).alias("s"), F.when(broad, 0.0).otherwise(F.col("radius_km")).alias("r"), "start")
    wide = F.col("radius_km") * F.when(F.col("score") < 1, MISSPELT).otherwise(1.0)
    method = F.when(F.col("kind") == "province", "admin_centroid").otherwise("gazetteer")
    pick = F.struct("lat", "lon", F.col("name").alias("place"), wide.alias("radius_km"), method.alias("method"), "province")
    return x.groupBy(key).agg(F.min_by(pick, order).alias("location"), F.min_by("phrase", "start").alias("place_text"))


def named(matches: DataFrame, names: list[str], key: str) -> DataFrame:
    """key, actors (in the order of the text, each once) and the text of the first."""
    name = F.get(F.array(*map(F.lit, names)), F.col("ord").cast("int"))
    first = matches.withColumn("name", name).groupBy(key, "name").agg(F.min("start").alias("start"), F.min_by("phrase", "start").alias("phrase"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "name")))  # a text's different actors
    return first.groupBy(key).agg(ordered["name"].alias("actors"), F.min_by("phrase", "start").alias("actor_text"))


def extract(reports: DataFrame, text: str = "text", published: str = "created_at", also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``reports`` with folded, words, language, certainty, cue, when (struct(ts, uncertainty_min) or null), fatalities,
    injured, abducted, displaced, location, place_text, actors, actor_text.

    All that follows from a text alone is worked out once for each different text, and joined to the reports. ``also``
    adds further columns of that kind to the table of texts, which has those above but ``when``."""
    spark, has = reports.sparkSession, F.coalesce(F.col(text), F.lit(""))
    x = reports.withColumn("folded", fold_key(has)).withColumn("_h", F.struct(F.xxhash64("folded"), F.xxhash64("folded", F.lit(1))))
    x = cut(x)  # folded once, read for the texts and for the rest
    once = cut(x.groupBy("_h").agg(F.first("folded").alias("folded")).withColumn("words", tokens(F.col("folded"))))
    people = [(a[0], a[3]) for a in dims.ACTORS]
    places = gazetteer(spark)
    found = longest_matches(once, dictionary(spark, [(p[0], p[7]) for p in dims.PLACES] + [(p[0], []) for p in dims.PROVINCES]), "_h", "words")
    where = located(found, places, "_h")
    who = named(longest_matches(once, dictionary(spark, people), "_h", "words"), [p[0] for p in people], "_h")
    said = once.join(where, "_h", "left").join(who, "_h", "left").withColumn("_n", F.transform("words", numeral))
    folded, words = F.col("folded"), F.col("words")
    said = said.withColumns({**casualties(words, F.col("_n")), "_sure": certainty(folded), "_stated": stated_time(folded, words), "language": detect_language(words)})
    said = said.withColumns({"certainty": F.col("_sure.level"), "cue": F.col("_sure.cue"), "actors": F.coalesce("actors", F.array().cast("array<string>"))}).drop("_n", "_sure")
    said = cut(also(said) if also else said)
    x = x.drop(*[c for c in said.columns if c != "_h"]).join(said, "_h")
    return x.withColumn("when", at_stated(F.col("_stated"), F.col(published))).drop("_h", "_stated")


def normalise(reports: DataFrame, observations: DataFrame, now: datetime) -> DataFrame:
    """One event a report. ``reports``: source_id, source_type, handle, url, text, created_at, lang, and geo_lat, geo_lon,
    geo_radius_km (or nulls). ``observations``: key (a source type, or type:handle), correct, weight, at.

    A stated position beats a named place. The source's grade and prior come from its type's profile and the observations
    of its type and of its own; a report's confidence is its prior times its type's score. What has neither a place nor
    a type is dropped."""
    spark = reports.sparkSession
    counts = [F.col(c) for c in ("fatalities", "injured", "abducted", "displaced")]
    x = extract(reports, also=lambda said: classified(said, F.col("folded"), F.col("actors"), *counts, name="class"))
    geo = F.col("geo_lat").isNotNull() & F.col("geo_lon").isNotNull()
    near = settlement_at(F.col("geo_lat"), F.col("geo_lon"), NAMED_KM)
    x = cut(x.withColumn("_near", F.when(geo, near)).drop("folded", "words"))  # columns, not what they come from, go on
    province = F.lit(None).cast("string")
    for p in dims.PLACES:
        province = F.when(F.col("_near") == p[0], p[6]).otherwise(province)
    stated = F.struct(
        F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon"), F.coalesce("_near", F.lit("raw coordinates")).alias("place"),
        F.coalesce("geo_radius_km", F.lit(1.0)).alias("radius_km"), F.lit("exact").alias("method"), province.alias("province"),
    )
    x = x.withColumn("location", F.when(geo, stated).otherwise(F.col("location"))).where(F.col("location").isNotNull() | (F.col("class.type") != "unknown"))
    return with_sources(x, observations, now, spark)


def with_sources(x: DataFrame, observations: DataFrame, now: datetime, spark: SparkSession) -> DataFrame:
    """The last step of ``normalise``: sources' grades, and the columns of an event."""
    profiles = spark.createDataFrame(dims.SOURCE_PROFILES, "type string, family string, grade string, credibility int, strength int")
    default = next(p for p in dims.SOURCE_PROFILES if p[0] == dims.DEFAULT_SOURCE)
    known = x.select("source_type", "handle").distinct().join(F.broadcast(profiles), F.col("source_type") == F.col("type"), "left")
    sources = known.select(
        "source_type", "handle", F.coalesce("family", F.lit(default[1])).alias("family"), F.coalesce("grade", F.lit(default[2])).alias("grade"), F.coalesce("strength", F.lit(default[4])).alias("strength"),
    )
    # An observation counts for every source of its type, or for the one of its type and handle. Observations are summed
    # by key first, and a source looks up two sums: the join has two rows a source, however many observations there are.
    each = sources.select("source_type", "handle", F.explode(F.array_compact(F.array("source_type", F.concat_ws(":", "source_type", "handle")))).alias("key")).distinct()
    found = each.join(decayed(observations, ["key"], now), "key").withColumn("handle", F.coalesce("handle", F.lit("")))
    seen = found.groupBy("source_type", "handle").agg(*[F.sum(c).alias(c) for c in ("alpha", "beta", "n")])
    graded = posterior_of_sums(sources.withColumn("handle", F.coalesce("handle", F.lit(""))), seen, ["source_type", "handle"])
    graded = graded.select("source_type", F.col("handle").alias("_handle"), "family", F.col("mean").alias("_mean"), F.col("posterior_grade").alias("source_grade"))
    y = x.withColumn("_handle", F.coalesce("handle", F.lit(""))).join(graded, ["source_type", "_handle"])
    credible = credibility_of(F.col("certainty"), F.col("location").isNotNull(), F.size("actors") > 0, F.col("when").isNotNull())
    return y.select(
        "source_id", "source_type", "handle", "url", "family", "source_grade", F.round("_mean", 3).alias("prior"), credible.alias("credibility"),
        F.coalesce("when.ts", "created_at").alias("ts"), F.coalesce("when.uncertainty_min", F.lit(UNTIMED_MIN)).alias("time_uncertainty_min"),
        "location.lat", "location.lon", "location.place", "location.radius_km", "location.method", "location.province",
        F.col("class.type").alias("event_type"), F.col("class.alts").alias("alts"), "actors", summarise(F.coalesce("text", F.lit(""))).alias("description"),
        "fatalities", "injured", "abducted", "displaced", F.coalesce("lang", "language").alias("language"), "certainty", F.coalesce("place_text", "actor_text").alias("matched_span"),
        F.round(F.col("_mean") * F.when(F.col("class.score") > 0, F.col("class.score")).otherwise(UNSCORED), 3).alias("report_confidence"),
        F.when(F.col("certainty") == "denied", "contradict").otherwise("agree").alias("agreement"), F.col("created_at").alias("published_at"),
    )
