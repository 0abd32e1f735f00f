"""Ids that sort by time: 48 bits of milliseconds and 80 bits of a hash, in 26 characters of base 32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: digits of base 32 without I, L, O and U.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def base32(x: Column, digits: int) -> Column:
    """A non-negative long in so many digits, leading zeros kept."""
    return F.concat(*[F.substring(F.lit(DIGITS), (F.shiftright(x, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(digits - 1, -1, -1)])


def time_id(ts: Column, *key: Column) -> Column:
    """An id of a moment and a key: ids order as moments do, in milliseconds, and equal keys of one moment share theirs, so
    a repeated task gives the same ids. Null without a moment; parts of a key that are null count as empty."""
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), 256)
    half = lambda at: F.conv(F.substring(digest, at, 10), 16, 10).cast("long")  # noqa: E731  (40 bits)
    return F.concat(base32(ms, 10), base32(half(1), 8), base32(half(11), 8))
