"""Evidence records: validation, attention, retrieval and entities."""

from __future__ import annotations

import unicodedata
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import question_terms, unmark
from ..functions.times import is_real_date


def source_errors(title: Column, publisher: Column, url: Column, published: Column, retrieved: Column, today: date) -> Column:
    """Names of the fields of a source that are wrong (array)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    scheme, http = F.regexp_like(url, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), F.regexp_like(url, F.lit(r"(?i)^https?://[^/?#\s]+"))
    day = F.lit(today.isoformat())
    dated = ~blank(published)
    bad_published = dated & (~is_real_date(published) | (published > day))
    bad_retrieved = ~is_real_date(retrieved) | (retrieved > day) | (dated & is_real_date(published) & (retrieved < published))
    checks = {"title": blank(title), "publisher": blank(publisher), "url": blank(url) | (scheme & ~http), "published": bad_published, "retrieved": bad_retrieved}
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()]))


def record_errors(title: Column, sector: Column, country: Column, summary: Column, lat: Column, lon: Column, status: Column, confidence: Column, sources: Column, sectors: list[str]) -> Column:
    """Names of the fields of a record that are wrong (array). ``sources``: their number."""
    n = F.length(F.trim(F.coalesce(title, F.lit(""))))
    outside = (lat.isNull() != lon.isNull()) | F.coalesce(~lat.between(-90, 90), F.lit(False)) | F.coalesce(~lon.between(-180, 180), F.lit(False))
    checks = {
        "title": (n < 8) | (n > 140),
        "sector": ~F.coalesce(sector.isin(*sectors), F.lit(False)),
        "country": F.trim(F.coalesce(country, F.lit(""))) == "",
        "summary": F.length(F.trim(F.coalesce(summary, F.lit("")))) < 20,
        "coords": outside,
        "status": status.isin("verified", "in_review") & (sources == 0),
        "confidence": (confidence == "high") & (sources < 2),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))


def attention(status: Column, confidence: Column, sources: Column, undated: Column, unclear: Column, age_days: Column, illustrative: Column) -> Column:
    """0 to 100: how much a record asks for work. sources, undated, unclear: numbers."""
    points = (
        F.when(sources == 0, 35).when(sources == 1, 15).otherwise(0)
        + F.when(status == "disputed", 30).when(status == "draft", 15).when(status == "in_review", 10).otherwise(0)
        + F.when(confidence == "low", 15).when(confidence == "medium", 5).otherwise(0)
        + F.when(age_days > 180, 20).when(age_days > 60, 10).otherwise(0)
        + F.when(undated > 0, 5).otherwise(0)
        + F.when(unclear > 0, 10).otherwise(0)
        + F.when(illustrative, 10).otherwise(0)
    )
    return F.when(status == "archived", 0).otherwise(F.least(F.lit(100), points)).cast("int")


def scored(rows: DataFrame, question: str, fields: dict[str, tuple[Column, int]]) -> DataFrame:
    """``rows`` with score: what the question's terms weigh in the fields that contain them. ``fields``: a free name, the
    field's text and its weight. A field is folded once for all terms."""
    folded = rows.withColumns({k: unmark(F.coalesce(c, F.lit(""))) for k, (c, _) in fields.items()})
    score = F.lit(0)
    for k, (_, weight) in fields.items():
        for t in question_terms(question):
            score = score + F.when(F.contains(F.col(k), F.lit(t)), weight).otherwise(0)
    return folded.withColumn("score", score).drop(*fields)


def retrieve(records: DataFrame, question: str, most: int = 6) -> DataFrame:
    """The records that answer a question best, with score. ``records``: title, entities (array), meta, body, updated_at
    and id. A term counts 3 in the title and in the entities, 2 in the meta data, 1 in the body. A top-k: a limit is
    the feature."""
    fields = {"_title": (F.col("title"), 3), "_entities": (F.array_join("entities", " "), 3), "_meta": (F.col("meta"), 2), "_body": (F.col("body"), 1)}
    out = scored(records, question, fields).where("score > 0")
    return out.orderBy(F.col("score").desc(), F.col("updated_at").desc(), "id").limit(most)


#: Status that stands for all but the archive.
ACTIVE, ARCHIVED = "active", "archived"


def selected(query: str = "", sector: str | None = None, status: str | None = ACTIVE) -> Column:
    """Whether a record (title, summary, country, region, sector, status, entities: array, sources: array of structs with
    title and publisher) is of the sector (none: any) and status (``active``: all but archived ones; none: any), and holds
    every word of the query somewhere, its entities and the titles and publishers of its sources included. Case and marks
    do not count; a word may be part of another. Nulls are empty, and a null status is not the archive."""
    own = F.lit(True) if sector is None else F.coalesce(F.col("sector") == sector, F.lit(False))
    if status == ACTIVE:
        own &= F.coalesce(F.col("status") != ARCHIVED, F.lit(True))
    elif status is not None:
        own &= F.coalesce(F.col("status") == status, F.lit(False))
    terms = question_words(query)
    if not terms:
        return own
    nested = F.flatten(F.transform("sources", lambda x: F.array(x["title"], x["publisher"])))
    fields = F.concat(F.array(*[F.col(c) for c in ("title", "summary", "country", "region", "sector")]), F.coalesce("entities", F.array().cast("array<string>")), F.coalesce(nested, F.array().cast("array<string>")))
    hay = unmark(F.array_join(F.array_compact(fields), " "))
    return own & F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, t))


def question_words(query: str) -> list[str]:
    """The query's different words without case and marks, in order."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.combining(c)).lower()
    return list(dict.fromkeys(plain.split()))


def cooccurrence(mentions: DataFrame, record: str, entity: str) -> DataFrame:
    """a, b (a < b), shared: in how many records two entities meet; ``mentions`` has a row each. A record's entities are
    paired within it, so a record should name no more than a few hundred."""
    m = mentions.select(F.col(record).alias("r"), F.trim(F.col(entity)).alias("e")).where("e <> ''").distinct()
    pairs = m.withColumnRenamed("e", "a").join(m.withColumnRenamed("e", "b"), "r").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def entities(mentions: DataFrame, record: str, entity: str, sector: str) -> DataFrame:
    """entity, records, sectors of every entity; the most frequent first."""
    m = mentions.select(F.col(record).alias("r"), F.trim(F.col(entity)).alias("entity"), F.col(sector).alias("s")).where("entity <> ''")
    return m.groupBy("entity").agg(F.count_distinct("r").alias("records"), F.count_distinct("s").alias("sectors")).orderBy(F.col("records").desc(), "entity")
