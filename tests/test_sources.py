import json
from datetime import datetime

from pyspark.sql import functions as F

from orrery.operators import linkage
from orrery.sources import exports, feeds

NOW = datetime(2024, 1, 31)


def payload(spark, x):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),)], "payload string")


def test_articles(spark):
    a = {"url": "https://a.example.org/1", "title": "Two , words", "seendate": "20240102T030405Z", "domain": "a", "language": "English"}
    rows = [a, a | {"title": "two, WORDS", "seendate": "20240103T030405Z"}, a | {"url": "ftp://x"}, a | {"seendate": "x"}, a | {"title": None}]
    got = feeds.articles(payload(spark, {"articles": rows})).collect()
    assert [(r["title"], r["ts"]) for r in got] == [("Two, words", datetime(2024, 1, 2, 3, 4, 5))]
    assert feeds.articles(payload(spark, "junk")).collect() == []


def test_feed_items(spark):
    rss = """<rss><item><title>A &amp; B</title><link>https://x.example.org/a</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>
    <description><![CDATA[<p>Hello</p>]]></description></item><item><title></title><link>y</link></item></rss>"""
    atom = '<feed><entry><title>T</title><link href="https://x.example.org/b"/><published>2024-01-02T03:04:05Z</published><summary>s</summary></entry></feed>'
    got = [tuple(r) for r in feeds.feed_items(payload(spark, rss).union(payload(spark, atom))).collect()]
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert got == [("A & B", "https://x.example.org/a", at, "Hello"), ("T", "https://x.example.org/b", at, "s")]


def test_posts(spark):
    x = {"data": [{"id": "1", "text": "hi https://t.co/abc", "author_id": "u", "created_at": "2024-01-02T00:00:00Z", "lang": "en"}, {"id": "2", "text": "b", "author_id": "v"}]}
    x["includes"] = {"users": [{"id": "u", "username": "name", "verified": True}]}
    got = {r["source_id"]: (r["handle"], r["source_type"], r["text"]) for r in feeds.posts(payload(spark, x)).collect()}
    assert got == {"post:1": ("@name", "social_verified", "hi"), "post:2": (None, "social_unverified", "b")}


def test_years_points_and_floods(spark):
    a = feeds.yearly(payload(spark, {"items": [{"year": 2023, "total": "5"}, {"year": 2023, "total": "-"}]}), "a")
    b = feeds.yearly(payload(spark, {"items": [{"year": 2024, "total": "7"}]}), "b")
    assert [tuple(r) for r in feeds.merge_years(a, b).collect()] == [(2023, 5.0, None), (2024, None, 7.0)]
    g = [{"type": "Point", "date": "2024-01-01T00:00:00Z", "coordinates": [1.0, 2.0]}, {"type": "Point", "date": "2024-01-02T00:00:00Z", "coordinates": [3.0, 4.0]}, {"type": "Polygon"}]
    (e,) = feeds.latest_points(payload(spark, {"events": [{"id": "e", "title": "t", "categories": [{"title": "c"}], "geometry": g}, {"id": "f", "geometry": []}]})).collect()
    assert (e["lat"], e["lon"], e["category"], e["closed"]) == (4.0, 3.0, "c", False)
    days = [f"2024-01-{i:02d}" for i in range(1, 13)]
    (f,) = feeds.discharge(payload(spark, {"latitude": 1.0, "longitude": 2.0, "daily": {"time": days, "river_discharge": [9.0, 9.0] + [2.0] * 7 + [4.0, 8.0, 3.0]}}), "2024-01-10").collect()
    assert (f["now"], f["ratio"], f["peak"], f["peak_day"]) == (4.0, 2.0, 8.0, "2024-01-11")


def test_connectivity_and_funding(spark):
    t = int(datetime(2024, 1, 30, 12).timestamp())
    rows = [{"datasource": "a", "time": t, "level": "critical"}, {"datasource": "a", "time": t + 60, "level": "normal"}, {"datasource": "b", "time": t, "level": "warning"}]
    (c,) = feeds.connectivity(payload(spark, {"data": rows}), NOW).collect()
    assert tuple(c) == ("degraded", 1, 2)
    x = {"total": 50.0, "donors": [{"name": "p", "funding": 1.0}, {"name": "q", "funding": 9.0}], "plans": [{"name": "old", "years": ["2023"], "required": 1.0}, {"name": "new", "years": ["2024"], "required": 200.0}]}
    (f,) = feeds.funding(payload(spark, x), 2024).collect()
    assert (f["plan"], f["coverage"], f["donors"][0]["name"]) == ("new", 0.25, "q")


def test_wire_and_types(spark):
    one = spark.createDataFrame([("a", datetime(2024, 1, 30)), ("old", datetime(2024, 1, 1))], "source_id string, ts timestamp_ntz")
    two = spark.createDataFrame([("a", datetime(2024, 1, 30, 5), 1), ("b", datetime(2024, 1, 29), 2)], "source_id string, ts timestamp_ntz, n int")
    assert [(r["source_id"], r["n"]) for r in feeds.wire([one, two], NOW).collect()] == [("a", None), ("b", 2)]
    u = spark.createDataFrame([("https://www.radio.example.org/x",), ("https://other.example.net/",), (None,)], "u string")
    assert [r[0] for r in u.select(feeds.source_type(F.col("u"), {"example.org": "network_radio"})).collect()] == ["network_radio", "press_other", "press_other"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 'say "a", b', [1]), (None, 2.0, "x", [])], "lat double, lon double, name string, xs array<int>")
    (f,) = [json.loads(r["value"]) for r in exports.features(df).collect()]
    assert f["geometry"]["coordinates"] == [2.0, 1.0] and f["properties"] == {"name": 'say "a", b', "xs": [1]}
    exports.write_csv(df, f"{tmp_path}/c")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c")
    assert {(r["name"], r["xs"]) for r in back.collect()} == {('say "a", b', "[1]"), ("x", "[]")}


def test_streams(spark, tmp_path):
    from orrery.streaming import ingest

    rows = [("a", datetime(2024, 1, 1, 0, i), i % 4 != 3, True) for i in range(8)] + [("b", datetime(2024, 1, 1), True, False)]
    spark.createDataFrame(rows, "k string, ts timestamp, hit boolean, drop boolean").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("k string, ts timestamp, hit boolean, drop boolean").parquet(f"{tmp_path}/in")
    for name, stream in (("runs", ingest.runs(source, "k")), ("once", ingest.once(source, "k"))):
        q = stream.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    got = [r["run"] for r in spark.sql("select run from runs where k = 'a' order by ts").collect()]
    assert got == [1, 2, 3, 0, 1, 2, 3, 0] and spark.sql("select * from runs where outage").count() == 2
    assert spark.sql("select * from once").count() == 2


def test_unite_respects_limits():
    import pandas as pd

    at = {1: (0, 0.0, 0.0), 2: (600, 0.0, 0.1), 3: (1200, 0.0, 0.2), 4: (0, 0.0, 0.4)}
    links = [(1, 2, 0.9), (2, 3, 0.8), (1, 4, 0.7)]
    row = lambda a, b, s: (a, b, s, *at[a], *at[b])
    frame = pd.DataFrame([row(*x) for x in links], columns=["a", "b", "score", "a_min", "a_lat", "a_lon", "b_min", "b_lat", "b_lon"])
    got = dict(linkage.unite(frame).itertuples(index=False))
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}  # 3 is too late, 4 too far
