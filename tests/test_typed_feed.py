"""Filters of typed events and ids that sort by time, by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orrery.functions import ids
from orrery.operators import typed_feed as tf

NOW = datetime(2024, 1, 31)
SCHEMA = "i int, src string, type string, subtype string, date string, location string, admin1 string, fatalities long, actor1 string, actor2 string, notes string, desc string, platform string"


def events(spark):
    row = lambda i, src, type_, subtype=None, date=None, notes=None, dead=None, platform=None: (i, src, type_, subtype, date, None, None, dead, None, None, notes, None, platform)
    rows = [
        row(1, "acled", "Battles", "Armed clash", "2024-01-30"),
        row(2, "acled", "Riots", None, "2023-12-01", "Des réfugiés déplacés", 5),
        row(3, "drone", None, None, "", platform="UAS Heron"),
        row(4, "firms", "Thermal"),
        row(5, "cop", "Drone strike", None, "2024-01-28"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_filters(spark):
    e = events(spark)
    kept = lambda **x: [r["i"] for r in tf.filtered(e, NOW, **x).orderBy("i").collect()]
    assert kept() == kept(query="  ") == [1, 2, 3, 4, 5]
    assert kept(within="24h") == [1, 3, 4] and kept(within="72h") == [1, 3, 4, 5]
    assert kept(shared=tf.SECRET) == [3] and kept(shared=tf.CLASSIFIED) == [5] and kept(src="acled") == [1, 2]
    assert kept(kind="battle") == [1] and kept(kind="strike") == [5] and kept(kind="humanitarian") == [4]
    assert kept(query="HERON") == [3] and kept(query="réfugiés") == [2] and kept(query="none of it") == []
    tab = lambda t: [r["i"] for r in e.where(tf.in_activity(t)).orderBy("i").collect()]
    assert (tab("ALL"), tab("ALERTS"), tab("REPORTS"), tab("MOVEMENTS"), tab("FIRES")) == ([1, 2, 3, 4, 5], [1, 2], [], [2], [3, 4])
    assert [r["i"] for r in tf.page(e, [F.desc("i")], 2).collect()] == [5, 4]


def test_ids_sort_by_time(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(milliseconds=7 * i), i) for i in range(200)] + [(start, None), (None, 1)]
    got = spark.createDataFrame(rows, "ts timestamp_ntz, k long").withColumn("id", ids.time_id(F.col("ts"), F.col("k"))).collect()
    whole = [r["id"] for r in got if r["ts"] is not None and r["k"] is not None]
    assert whole == sorted(whole) and len(set(whole)) == 200 and {len(x) for x in whole} == {26} and set("".join(whole)) <= set(ids.DIGITS)
    assert got[200]["id"][:10] == whole[0][:10] and got[200]["id"] != whole[0] and got[201]["id"] is None
