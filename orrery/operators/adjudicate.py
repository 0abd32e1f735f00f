"""Decisions of analysts as append-only tables: what they teach of sources, merges by hand, and dismissed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Observations of a key that count, the newest: decay makes older ones irrelevant, so a limit is the feature.
HISTORY = 500
PARTIAL = 0.5


def credits(decisions: DataFrame, reports: DataFrame) -> DataFrame:
    """source_type, handle, correct, weight, at: every report of an event that is confirmed or rejected speaks for or
    against its source. A report that contradicted a confirmed event was wrong, and right about a rejected one; one that
    agreed in part counts half. ``decisions``: event_id, action, at; ``reports``: event_id, source_type, handle, agreement."""
    decided = decisions.where(F.col("action").isin("confirm", "reject")).select("event_id", "action", "at")
    right = (F.col("action") == "confirm") != (F.coalesce("agreement", F.lit("agree")) == "contradict")
    weight = F.when(F.col("agreement") == "partial", PARTIAL).otherwise(1.0)
    return reports.join(decided, "event_id").select("source_type", "handle", right.alias("correct"), weight.alias("weight"), "at")


def observe(new: DataFrame, before: DataFrame | None = None, most: int | None = HISTORY) -> DataFrame:
    """key, correct, weight, at: observations under the source's type and, where it has a handle, under ``type:handle``,
    with those of before; of each key the newest ``most`` (None: all)."""
    own = F.when(F.col("handle").isNotNull(), F.concat_ws(":", "source_type", "handle"))
    rows = new.select(F.explode(F.array_compact(F.array("source_type", own))).alias("key"), "correct", "weight", "at")
    rows = rows if before is None else before.select("key", "correct", "weight", "at").unionByName(rows)
    if most is None:
        return rows
    newest = Window.partitionBy("key").orderBy(F.col("at").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def merge(events: DataFrame, reports: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (event_id, status and others) with published_as, and their reports under the event that took them.
    ``merges``: event_id took in other_id. An event that is taken in is ``merged``; one named by itself, or not there,
    changes nothing; of several takers the first counts."""
    taken = merges.where("event_id <> other_id").groupBy("other_id").agg(F.min("event_id").alias("_into"))
    there = taken.join(events.select(F.col("event_id").alias("_into")).distinct(), "_into", "left_semi")
    out = events.join(there, events["event_id"] == there["other_id"], "left").drop("other_id")
    status = F.when(F.col("_into").isNotNull(), "merged").otherwise(F.col("status"))
    moved = reports.join(there, reports["event_id"] == there["other_id"], "left").drop("other_id")
    return (
        out.withColumn("status", status).withColumn("published_as", F.coalesce("_into", "event_id")).drop("_into"),
        moved.withColumn("event_id", F.coalesce("_into", "event_id")).drop("_into"),
    )


def undismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pairs (a, b) that nobody dismissed, in whatever order."""
    gone = dismissed.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
    return pairs.join(gone, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")
