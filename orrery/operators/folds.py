"""Folds over keys' rows in order, where no task needs a whole key.

Rows are sorted by key and order into ranges. A fold's state is carried over the end of a range only where the next one
begins with the same key, so a key of any size is spread, at the price of one round for each range that it fills alone:
what comes before must be known. The driver holds two keys and at most one state a range, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import cut

Step = Callable[[tuple, tuple], tuple[tuple, "tuple | None"]]


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` and _range, each range sorted and in a task of its own; written, so that ranges stay as they are."""
    placed = rows.repartitionByRange(parts, *keys, *order) if parts else rows.repartitionByRange(*keys, *order)
    return cut(placed.withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*keys, *order))


def fold(rows: DataFrame, keys: list[str], order: list[str], start: tuple, step: Step, state: str, out: str, parts: int | None = None) -> DataFrame:
    """``keys`` and the columns ``out`` of what ``step`` emits. It takes a state and a row (the columns that are no keys,
    in their order) and gives the next state, and a tuple to emit or None. ``state`` names the kinds of a state's parts,
    as ``out`` does of what is emitted. Keys are compared by value, so nulls are a key, and NaN is none to use. An empty
    table gives an empty one."""
    names = [c for c in rows.columns if c not in keys]
    placed = ranged(rows.select(*keys, *names), keys, order, parts)
    spark, kinds = placed.sparkSession, dict(placed.dtypes)
    key = F.struct(*keys)
    spans = [(r["_range"], tuple(r["a"]), tuple(r["b"])) for r in placed.groupBy("_range").agg(F.min(key).alias("a"), F.max(key).alias("b")).orderBy("_range").collect()]
    heirs = {a[0]: b[0] for a, b in zip(spans, spans[1:], strict=False) if a[2] == b[1]}
    last, whole, open_ = {r: b for r, _, b in spans}, {r for r, a, b in spans if a == b}, set(heirs.values())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for b in batches:
            yield list(zip(b["_range"].to_pylist(), zip(*[b[k].to_pylist() for k in keys], strict=True), zip(*[b[c].to_pylist() for c in names], strict=True), strict=True))

    def schema(text: str):
        kind = spark.createDataFrame([], text).schema
        return kind, to_arrow_schema(kind)

    ends_kind, ends_arrow = schema(f"_range int, {state}")
    begin: dict[int, tuple] = {}
    ready = [r for r in heirs if r not in open_ or r not in whole]
    while ready:
        known, asked = dict(begin), {r: last[r] for r in ready}

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = at = None
            for some in each(batches):
                for r, k, row in some:
                    if k == asked[r]:
                        if now is None:
                            at, now = r, known[r] if r in known and r in whole else start
                        now, _ = step(now, row)
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((at, *now), ends_arrow.types, strict=True)], schema=ends_arrow)

        done = placed.where(F.col("_range").isin(ready)).mapInArrow(ends, ends_kind).collect()  # a row a range
        begin |= {heirs[r["_range"]]: tuple(r)[1:] for r in done}
        ready = [heirs[r] for r in ready if heirs[r] in heirs and heirs[r] in whole]

    out_kind, out_arrow = schema(", ".join(f"{k} {kinds[k]}" for k in keys) + f", {out}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, of = True, start, None
        for some in each(batches):
            found = []
            for r, k, row in some:
                if first or k != of:
                    now, of, first = begin.get(r, start) if first else start, k, False
                now, emitted = step(now, row)
                if emitted is not None:
                    found.append((*k, *emitted))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), out_arrow.types, strict=True)], schema=out_arrow)

    return placed.mapInArrow(run, out_kind)


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], hit: Column, parts: int | None = None) -> DataFrame:
    """``rows`` with hit and run: how many hits in a row end here (0 where it is none; a null is none). Each range counts
    its own rows, and what a key's earlier ranges leave open comes from their sums, so this needs no rounds."""
    placed = ranged(rows.withColumn("hit", F.coalesce(hit, F.lit(False))), keys, order, parts)
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_i", F.count(F.lit(1)).over(here)).withColumn("_miss", F.max(F.when(~F.col("hit"), F.col("_i"))).over(here))
    sums = placed.groupBy("_range", *keys).agg(F.max("_i").alias("_n"), F.max("_miss").alias("_m"))
    up = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(up), F.lit(0)))
    open_ = F.col("_start") - F.coalesce(F.max(F.col("_start") + F.col("_m")).over(up), F.lit(0))
    starts = starts.select(F.col("_range").alias("_in"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], open_.alias("_open"))
    same = F.col("_range") == F.col("_in")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    run = F.col("_i") - F.coalesce(F.col("_miss"), -F.col("_open"))
    return placed.join(starts, same).select(*rows.columns, "hit", run.cast("long").alias("run"))
