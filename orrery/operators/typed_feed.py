"""Filters over typed events of all feeds (src, type, subtype, date, location, admin1, fatalities, actor1, actor2, notes,
desc, platform; texts may be null): by age, origin, kind, words and classification.

Every filter is a condition on columns, so it reaches the scan; ``page`` alone orders and cuts, as the feed shows a page.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classifications, days of a range, words of a kind, fields that are searched, and events of a page.
SECRET, CLASSIFIED, OPEN = "SECRET", "CLASSIFIÉ", "NON-CLASSIFIÉ"
DAYS = {"24h": 1, "72h": 3, "7d": 7, "30d": 30}
KINDS = {
    "battle": ["battle", "clash"],
    "strike": ["drone", "strike", "explo", "shell"],
    "civilian": ["civilian", "violence"],
    "humanitarian": ["idp", "humanitarian"],
}
MOVING = ["déplac", "deplac", "refuge", "idp"]
SEARCHED = ["type", "subtype", "location", "admin1", "actor1", "actor2", "notes", "desc", "platform"]
DEADLY, PAGE = 5, 300


def _any_in(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found |= F.contains(text, F.lit(w))
    return found


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def classification() -> Column:
    """How an event may be shared: by where it was collected."""
    return F.when(F.col("src") == "drone", SECRET).when(F.col("src") == "cop", CLASSIFIED).otherwise(OPEN)


def recent(now: datetime, within: str) -> Column:
    """Whether an event's day is in the range (``all``, or a key of ``DAYS``) before ``now``; one without a day is."""
    if within == "all":
        return F.lit(True)
    return (_text("date") == "") | (F.col("date") >= F.lit((now - timedelta(days=DAYS[within])).date().isoformat()))


def of_kind(kind: str) -> Column:
    """Whether type and subtype hold a word of the kind (``all``, or a key of ``KINDS``); thermal points are humanitarian."""
    if kind == "all":
        return F.lit(True)
    found = _any_in(F.lower(F.concat(_text("type"), _text("subtype"))), KINDS[kind])
    return found | (F.col("src") == "firms") if kind == "humanitarian" else found


def mentions(query: str) -> Column:
    """Whether any searched field holds the query, whatever the case; blanks alone ask for nothing."""
    if not query.strip():
        return F.lit(True)
    found = F.lit(False)
    for c in SEARCHED:
        found |= F.contains(F.lower(_text(c)), F.lit(query.lower()))
    return found


def in_activity(tab: str) -> Column:
    """Whether an event is in a tab of recent activity: ALL, ALERTS, REPORTS, MOVEMENTS or FIRES."""
    return {
        "ALL": F.lit(True),
        "ALERTS": (F.coalesce("fatalities", F.lit(0)) >= DEADLY) | (_text("type") == "Battles"),
        "REPORTS": _text("type") == "Strategic developments",
        "MOVEMENTS": _any_in(F.lower(_text("notes")), MOVING),
        "FIRES": F.col("src").isin("drone", "firms") | (_text("type") == "Explosions/Remote violence"),
    }[tab]


def filtered(events: DataFrame, now: datetime, query: str = "", within: str = "all", shared: str | None = None, src: str | None = None, kind: str = "all") -> DataFrame:
    """Events that pass every filter; ``shared``: a classification, ``src``: a feed (none: all)."""
    own = recent(now, within) & mentions(query) & of_kind(kind)
    if shared is not None:
        own &= classification() == shared
    if src is not None:
        own &= F.col("src") == src
    return events.where(own)


def page(events: DataFrame, order: list[Column], most: int = PAGE) -> DataFrame:
    """The first events in an order: what a screen shows."""
    return events.orderBy(*order).limit(most)
