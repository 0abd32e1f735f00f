"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_dir

__all__ = ["BATCH_ROWS", "WORD", "cut", "free_name", "look_up", "n_words", "place", "read", "shared_dir", "shared_path", "small_batches", "written"]
#: A word is a maximal run of characters other than ASCII blanks (Java regex).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to a Python worker at once: with long texts a larger batch could outgrow a worker.
BATCH_ROWS = 1000
#: A key of more than one in so many rows is hot (there are fewer such keys than that) if it has this many rows; rows of a
#: hot key are spread over so many tasks.
HOT, HOT_ROWS, SALTS = 1000, 1000, 32


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at a time. The bound is the session's, as Spark reads it when a plan runs, and it
    stays: later queries with Python steps get batches of as many rows, or fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place(df: DataFrame, name: str) -> int:
    """Where the column is that Spark means by ``name``: the one of exactly that name, else (unless Spark minds case) the
    one that differs in case alone."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    alike = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    minds = str(df.sparkSession.conf.get("spark.sql.caseSensitive")).lower() == "true"
    found = exact if exact or minds else alike
    if len(found) != 1:
        raise ValueError(f"no single column {name} among {df.columns}")
    return found[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; none of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def look_up(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``table``, which has a key once, and in ``n`` how many rows have it. Rows of a hot key meet
    copies of its entry in several tasks."""
    table = cut(table)
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = [r[0] for r in table.where((F.col(n) * HOT > total) & (F.col(n) >= HOT_ROWS)).select(key).collect()]
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as a table in the shared folder and read again. A checkpoint keeps what the optimiser knows of a
    plan's columns, and in a loop that renames columns that knowledge grows from round to round; a table has none."""
    where = shared_path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
