"""Distances, cells and containment, as expressions over latitude and longitude columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Axis and square of the excentricity of the ellipsoid, scale on a zone's meridian, letters of bands, columns and rows.
AXIS_M, ECC2, SCALE = 6378137.0, 0.00669438, 0.9996
BANDS, COLUMNS, ROWS = "CDEFGHJKLMNPQRSTUVWX", "ABCDEFGHJKLMNPQRSTUVWXYZ", "ABCDEFGHJKLMNPQRSTUV"
KM_LAT, KM_LON = 110.57, 111.32


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1: Column | float, lon1: Column | float, lat2: Column | float, lon2: Column | float) -> Column:
    a, b, c, d = map(_col, (lat1, lon1, lat2, lon2))
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))
    h = half(c - a) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * half(d - b)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def segment_km(lat: Column, lon: Column, start: tuple[float, float], end: tuple[float, float]) -> Column:
    """Distance to a segment between (lon, lat) points in a plane around the point."""
    kx = KM_LON * F.cos(F.radians(lat))
    ax, ay = (F.lit(start[0]) - lon) * kx, (F.lit(start[1]) - lat) * KM_LAT
    dx, dy = F.lit(end[0] - start[0]) * kx, F.lit((end[1] - start[1]) * KM_LAT)
    span = dx * dx + dy * dy
    t = F.when(span == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / span)))
    return F.hypot(ax + t * dx, ay + t * dy)


def nearest_of(features: Sequence[tuple[str, Column]]) -> Column:
    """struct(km, name) of the nearest of (name, distance); of equal distances the earlier."""
    each = [F.struct(km.alias("km"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, km) in enumerate(features)]
    best = each[0] if len(each) == 1 else F.least(*each)
    return F.struct(best["km"].alias("km"), best["name"].alias("name"))


def in_ring(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Ray casting against a closed ring of (lon, lat): an odd number of crossed edges."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        crossed = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < F.lit(x2 - x1) * (lat - y1) / (y2 - y1) + x1)
        crossings = crossings + crossed.cast("int")
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & (crossings % 2 == 1)


def mercator_px(lat: Column, lon: Column, zoom: float, tile: int = 256) -> tuple[Column, Column]:
    """World pixel coordinates; latitudes are held to +-85."""
    scale = tile * 2.0**zoom
    s = F.sin(F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat))))
    return (lon + 180) / 360 * scale, (0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi)) * scale


def circle(lat: Column, lon: Column, km: Column | float, steps: int = 36) -> Column:
    """A closed ring of (lon, lat) around a point, ``km`` away."""
    at = lambda i: i * (2 * math.pi / steps)
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.array(
            lon + _col(km) * F.sin(at(i)) / (KM_LON * F.cos(F.radians(lat))),
            lat + _col(km) * F.cos(at(i)) / KM_LAT,
        ),
    )


def band_of(lat: Column, km: float) -> Column:
    """Number of the band of latitude, ``km`` high."""
    return F.floor(lat * KM_LAT / km).cast("int")


def cell_in(band: Column, lon: Column, km: float) -> Column:
    """Number of the cell in a band, at least ``km`` wide all over the band and its neighbours."""
    edge = F.greatest(F.abs(band), F.abs(band + 1)) + 1
    width = F.least(F.lit(360.0), km / (KM_LON * F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(90.0), edge * km / KM_LAT))))))
    return F.floor(lon / width).cast("int")


def utm_zone(lat: Column, lon: Column) -> Column:
    """Number of a point's zone, wider ones of the north included."""
    plain = F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)
    far = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lon >= 0) & (lon < 42), far).otherwise(plain)


def utm(lat: Column, lon: Column) -> Column:
    """struct(zone, east, north) in metres by the transverse Mercator series; north counts from the equator, negative south
    of it. Null outside of -80 to 84 degrees or -180 to 180, and for nulls."""
    bind = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  binds a value: inlined, it would be computed anew at each use

    def series(v: Column) -> Column:
        second = ECC2 / (1 - ECC2)
        n = AXIS_M / F.sqrt(1 - ECC2 * v["s"] * v["s"])
        t, c = F.pow(v["t"], F.lit(2.0)), second * v["c"] * v["c"]
        a = v["c"] * v["l"]
        east = a + (1 - t + c) * F.pow(a, F.lit(3.0)) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * F.pow(a, F.lit(5.0)) / 120
        e4, e6 = ECC2**2, ECC2**3
        arc = AXIS_M * (
            (1 - ECC2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * v["p"]
            - (3 * ECC2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * v["p"])
            + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * v["p"])
            - (35 * e6 / 3072) * F.sin(6 * v["p"])
        )
        up = a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, F.lit(4.0)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * F.pow(a, F.lit(6.0)) / 720
        return F.struct(v["zone"].alias("zone"), (SCALE * n * east + 500000).alias("east"), (SCALE * (arc + n * v["t"] * up)).alias("north"))

    p = F.radians(lat)
    inside = lat.between(-80, 84) & lon.between(-180, 180)
    parts = bind(
        F.struct(utm_zone(lat, lon).alias("zone"), p.alias("p"), lon.alias("lon")),
        lambda z: F.struct(
            z["zone"].alias("zone"), z["p"].alias("p"), F.sin(z["p"]).alias("s"), F.cos(z["p"]).alias("c"), F.tan(z["p"]).alias("t"), F.radians(z["lon"] - (z["zone"] * 6 - 183)).alias("l")
        ),
    )
    return F.when(inside, bind(parts, series))


def mgrs(lat: Column, lon: Column, digits: int = 5) -> Column:
    """The military grid reference: zone, band, square of 100 km, and so many digits each of east and north, cut off. Null
    where ``utm`` is; the grid of the poles is not offered."""
    if not 0 <= digits <= 5:
        raise ValueError("a grid reference has 0 to 5 digits")
    band = F.substring(F.lit(BANDS), F.least(F.lit(20), F.floor((lat + 80) / 8).cast("int") + 1), F.lit(1))

    def text(u: Column) -> Column:
        east, north = F.floor(u["east"]), F.floor(u["north"] + F.when(u["north"] < 0, 10000000.0).otherwise(0.0))
        column = F.pmod(u["zone"] - 1, F.lit(3)) * 8 + F.floor(east / 100000)
        row = F.pmod(F.floor(north / 100000) + F.when(u["zone"] % 2 == 0, 5).otherwise(0), F.lit(20)) + 1
        within = lambda x: F.lpad(F.floor(F.pmod(x, F.lit(100000)) / 10 ** (5 - digits)).cast("string"), digits, "0") if digits else F.lit("")
        square = F.concat(F.substring(F.lit(COLUMNS), column.cast("int"), F.lit(1)), F.substring(F.lit(ROWS), row.cast("int"), F.lit(1)))
        return F.concat(u["zone"].cast("string"), u["band"], square, within(east), within(north))

    at = utm(lat, lon)
    whole = F.transform(F.array(at), lambda u: F.struct(u["zone"].alias("zone"), u["east"].alias("east"), u["north"].alias("north"), band.alias("band")))
    return F.transform(whole, text)[0]


def position_text(lat: Column, lon: Column, decimals: int = 4) -> Column:
    """A point for display: absolute degrees with up to eight decimals, and their letters."""
    one = lambda x, pos, neg: F.concat(F.format_string(f"%.{max(0, min(8, decimals))}f", F.abs(x)), F.lit("°"), F.when(x >= 0, pos).otherwise(neg))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws("  ", one(lat, "N", "S"), one(lon, "E", "W")))
