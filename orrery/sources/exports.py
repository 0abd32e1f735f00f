"""Writers: CSV, GeoJSON, and JSON lines, by Spark's own writers; every task writes its own part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NESTED = ("array", "struct", "map")


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON."""
    flat = [F.to_json(f"`{c}`").alias(c) if kind.startswith(NESTED) else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def features(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A GeoJSON feature (text, column ``value``) for every row with a finite position."""
    la, lo = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    rows = df.where(la.between(-90, 90) & lo.between(-180, 180))
    point = F.struct(F.lit("Point").alias("type"), F.array(lo, la).alias("coordinates"))
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (lat, lon)])
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), rest.alias("properties"))).alias("value"))


def write_features(df: DataFrame, path: str, lat: str = "lat", lon: str = "lon") -> None:
    """One feature a line."""
    features(df, lat, lon).write.mode("overwrite").text(path)
