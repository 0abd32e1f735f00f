"""Times: parsing of feeds' formats, resolution of relative expressions, and their rendering. All times are UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues in the order in which they are tried, minutes to add, uncertainty in minutes.
TIME_CUES = [
    (["maintenant", "actuellement", "sasa", "en ce moment"], 0, 30),
    (["ce matin", "asubuhi", "matin"], -300, 180),
    (["cet apres midi", "apres midi", "mchana"], -180, 150),
    (["ce soir", "soir", "jioni"], -60, 120),
    (["cette nuit", "nuit", "usiku", "butu"], -420, 240),
    (["aujourd hui", "leo", "lelo"], -360, 360),
    (["hier", "jana", "lobi"], -1440, 480),
    (["avant hier", "juzi"], -2880, 600),
    (["la semaine derniere", "wiki iliyopita"], -10080, 3600),
]
WEEKDAYS = ["dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi"]
SMALL_NUMBERS = {"un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7}


def compact_time(s: Column) -> Column:
    """``20260102T030405Z``; null for anything else."""
    plain = F.when(F.regexp_like(s, F.lit(r"^\d{8}T\d{6}Z$")), F.regexp_replace(s, "[TZ]", ""))
    return F.try_to_timestamp(plain, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def feed_time(s: Column) -> Column:
    """RFC 822 and ISO 8601 times of feeds; null for junk."""
    mail = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3},\s*", "")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z"]
    iso = F.when(F.regexp_like(s, F.lit(r"^\s*\d{4}-\d{2}-\d{2}")), F.try_to_timestamp(F.trim(s)))
    return F.coalesce(iso, *[F.try_to_timestamp(mail, F.lit(f)) for f in forms]).cast("timestamp_ntz")


def is_real_date(s: Column) -> Column:
    """``yyyy-MM-dd`` of a day that exists."""
    day = F.try_to_date(F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}$")), s), "yyyy-MM-dd")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd") == s, F.lit(False))


def add_minutes(t: Column, n: Column | int) -> Column:
    return F.timestamp_add("MINUTE", n if isinstance(n, Column) else F.lit(n), t)


def resolve_time(folded: Column, words: Column, published: Column) -> Column:
    """struct(ts, uncertainty_min) of what a folded text says of its time, null where it says nothing: an age, else the
    first cue (a clock time pins its hour), else a weekday, else a clock time, of the day before if it were ahead."""
    once = F.array(stated_time(folded, words))  # bound, since the time is made of it in many places
    return F.get(F.transform(once, lambda x: at_stated(x, published)), F.lit(0))


#: What a text may say: minutes from publication, those and an hour of that day, a weekday, an hour alone.
_OFFSET, _PINNED, _WEEKDAY, _CLOCK = range(4)


def stated_time(folded: Column, words: Column) -> Column:
    """What ``resolve_time`` needs of the text, which is the same for all equal texts."""
    number = F.regexp_extract(folded, r"il y a (\d+|un|une|deux|trois|quatre|cinq|six|sept)\s+(minutes?|heures?|jours?)", 1)
    unit_word = F.regexp_extract(folded, r"il y a (\d+|un|une|deux|trois|quatre|cinq|six|sept)\s+(minutes?|heures?|jours?)", 2)
    n = number.try_cast("int")
    for word, x in SMALL_NUMBERS.items():
        n = F.when(number == word, x).otherwise(n)
    unit = F.when(unit_word.startswith("minute"), 1).when(unit_word.startswith("heure"), 60).otherwise(1440)
    spread = F.when(unit == 1, 10).when(unit == 60, 45).otherwise(360)
    hour = F.regexp_extract(folded, r"(\d{1,2})\s*(?:h|:)\s*(\d{2})?", 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(folded, r"(\d{1,2})\s*(?:h|:)\s*(\d{2})?", 2).try_cast("int"), F.lit(0))
    has_clock, clock = (hour <= 23) & (minute <= 59), hour * 60 + minute
    col = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    said = lambda kind, uncertainty, offset=0, at=None: F.struct(col(kind).alias("kind"), col(offset).alias("offset"), col(at).alias("at"), col(uncertainty).alias("uncertainty_min"))
    out = [F.when(number != "", said(_OFFSET, spread, -n * unit))]
    for cues, offset, uncertainty in TIME_CUES:
        hit = F.lit(False)
        for c in cues:
            hit |= folded.contains(c)
        out.append(F.when(hit & has_clock, said(_PINNED, 45, offset, clock)).when(hit, said(_OFFSET, uncertainty, offset)))
    out += [F.when(F.array_contains(words, day), said(_WEEKDAY, 720, 0, i)) for i, day in enumerate(WEEKDAYS)]
    return F.coalesce(*out, F.when(has_clock, said(_CLOCK, 60, 0, clock)))


def at_stated(stated: Column, published: Column) -> Column:
    """struct(ts, uncertainty_min) of a ``stated_time``, for a text published then."""
    kind, at, t = stated["kind"], stated["at"], add_minutes(published, stated["offset"])
    pinned = lambda x: add_minutes(F.date_trunc("DAY", x).cast("timestamp_ntz"), at)
    back = F.pmod(F.dayofweek(published) - 1 - at, F.lit(7))
    clock = pinned(published)
    ts = (
        F.when(kind == _PINNED, pinned(t))
        .when(kind == _WEEKDAY, add_minutes(published, -1440 * F.when(back == 0, 7).otherwise(back)))
        .when(kind == _CLOCK, F.when(clock > published, add_minutes(clock, -1440)).otherwise(clock))
        .otherwise(t)
    )
    return F.when(stated.isNotNull(), F.struct(ts.alias("ts"), stated["uncertainty_min"].alias("uncertainty_min")))


def ago(t: Column, now: datetime) -> Column:
    """``5 min ago``, ``3 h ago``, ``2 d ago``."""
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    m = F.greatest(F.lit(0), half_up(F.timestamp_diff("MICROSECOND", t, F.lit(now).cast("timestamp_ntz")) / 6e7))
    h = half_up(m / 60)
    return (
        F.when(t.isNull(), "—")
        .when(m < 1, "just now")
        .when(m < 60, F.concat(m, F.lit(" min ago")))
        .when(h < 48, F.concat(h, F.lit(" h ago")))
        .otherwise(F.concat(half_up(h / 24), F.lit(" d ago")))
    )


def zulu(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm'Z'"), F.lit("—"))
