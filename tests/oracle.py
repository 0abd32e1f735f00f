"""Hold a query's rows against its SQL in DuckDB: names, kinds and values, without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

#: Spark's and DuckDB's names of a kind.
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]",
}


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db


def differences(df, db, sql: str) -> list[str]:
    """What differs; nothing if all is alike."""
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(names)
    if order != sorted(df.columns):
        return [f"columns: {sorted(df.columns)} and {order}"]
    kinds, out = dict(df.dtypes), []
    for name, kind, *_ in found.description:
        if KINDS.get(kinds[name], kinds[name]) != str(kind):
            out.append(f"kind of {name}: {kinds[name]} and {kind}")
    own = Counter(tuple(plain(r[c]) for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    if own != theirs:
        out.append(f"rows: {sum(own.values())} and {sum(theirs.values())}; only here {list((own - theirs).items())[:3]}; only there {list((theirs - own).items())[:3]}")
    return out
