"""Ingestion of report streams: each source_id once, late reports apart, counts by window, and incremental state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GRACE = "48 hours"


def once(reports: DataFrame, key: str = "source_id", grace: str = GRACE) -> DataFrame:
    """Reports whose key was not seen within the grace; later ones than that are dropped from the stream."""
    return reports.withWatermark("ts", grace).dropDuplicatesWithinWatermark([key])


def throughput(reports: DataFrame, window: str = "1 minute", grace: str = GRACE) -> DataFrame:
    """Reports by window and source type, final when the grace is over."""
    return reports.withWatermark("ts", grace).groupBy(F.window("ts", window).alias("w"), "source_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "source_type", "n")


def runs(samples: DataFrame, key: str, least: int = 3) -> DataFrame:
    """key, ts, run, outage for every sample (key, ts, hit, drop) as it comes: how many hits in a row end at it. The
    state of a key is one number; a batch's samples are taken in order of time."""

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run,) = state.get if state.exists else (0,)
        x = pd.concat(frames).sort_values("ts")
        out = []
        for hit in x["hit"]:
            run = run + 1 if hit else 0
            out.append(run)
        state.update((run,))
        outage = [r >= least and bool(d) for r, d in zip(out, x["drop"], strict=True)]
        yield pd.DataFrame({key: x[key].to_numpy(), "ts": x["ts"].to_numpy(), "run": out, "outage": outage})

    kind = f"{key} {dict(samples.dtypes)[key]}, ts timestamp, run long, outage boolean"
    return samples.groupBy(key).applyInPandasWithState(step, kind, "run long", "append", GroupStateTimeout.NoTimeout)
