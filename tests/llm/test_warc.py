import gzip
import hashlib
from collections import Counter

import pytest

from orrery.llm import warc
from orrery.llm.queries import op3_warc

BIG, ODD = "<p>équal\r\n\r\n</p>" * 90, "x" * 999
ROWS = (
    [(i, f"http://h{i % 7}.example.org/p{i}?q#f", f"<html>{i}</html>" * (i % 120)) for i in range(400)]
    + [(500 + i, "http://copy.example.org/", BIG) for i in range(30)]
    + [(600, "http://s/", ODD), (601, "http://s/", ODD), (602, "http://s/", ODD + "y"), (603, "http://s/", ODD + "y")]
    + [(None, None, None), (None, "u", BIG), (700, None, ""), (701, "http://ü.org/ä b\nc", None), (-5, "", "WARC/1.1\r\n\r\n" * 200), (702, "x", "l" * 300_000)]
    + [(510, "http://copy.example.org/", BIG), (800, "a", "n" * 2000), (800, "a", "n" * 2000)]
)
KIND = "page_id long, url string, html string"


def expected():
    groups = {}
    for k, _, t in ROWS:
        if len(b := (t or "").encode()) >= 1000 and k is not None:
            groups[b] = max(groups.get(b, k), k)
    out = Counter()
    for k, _, t in ROWS:
        b = (t or "").encode()
        keeper = groups.get(b)
        revisit = keeper is not None and k != keeper
        out[k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None] += 1
    return out


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, KIND).selectExpr("*", "1 as id", "2 as digest").write.parquet(f"{tmp_path}/pages.parquet")
    got = op3_warc(spark, str(tmp_path)).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected()


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    where = (tmp_path_factory.mktemp("warc") / "a").as_uri()
    captures = warc.write_archives(spark.createDataFrame(ROWS, KIND).repartition(3), where)
    return where, captures, warc.CaptureIndex.build(captures, where, block_lines=16)


def test_files_are_warc(archive):
    where, captures, _ = archive
    files = {r["file"] for r in captures.collect()}
    data = b"".join(gzip.open(f"{where[7:]}/{f}").read() for f in files)
    assert data.count(b"WARC-Record-ID: ") == len(ROWS) and data.startswith(b"WARC/1.1\r\nWARC-Type: ")


@pytest.mark.parametrize("most", [warc.MAX_DIRECTORY_BYTES, 500])
def test_lookup(spark, archive, most):
    from pyspark.sql import functions as F

    where, captures, index = archive
    assert index.directory.count() > 10
    some = spark.createDataFrame([(399, "http://h0.example.org/p399?q"), (14, "http://h0.example.org/p14?q#other"), (510, "http://copy.example.org/"), (9, "http://none/")], "page_id long, url string")
    got = warc.fetch(index.locate(some.select(warc.sort_key(F.col("url"), F.col("page_id")).alias("k")), most), where)
    assert Counter((r["id"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in got.collect()) == Counter({(399, "<html>399</html>" * 39): 1, (14, "<html>14</html>" * 14): 1, (510, None): 2})
    every = index.locate(captures.select("k"), most)
    assert every.count() == len(ROWS)


def test_payloads_round_trip(archive):
    where, captures, _ = archive
    got = Counter((r["id"], bytes(r["payload"]).decode()) for r in warc.fetch(captures, where).where("record_type = 'response'").collect())
    revisits = {(k, t) for k, _, t in ROWS if t == BIG and k != 529 or t == ODD + "y" and k == 602}
    assert got == Counter((k, t or "") for k, _, t in ROWS if (k, t) not in revisits)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/pages.parquet")
    assert op3_warc(spark, str(tmp_path)).collect() == []


def test_damage_is_seen():
    raw = warc.record(1, "http://a/", b"payload", None, False)
    assert warc.parse(raw).payload == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paYload"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-3])


def test_url_key(spark):
    urls = [("https://Www.Example.org/a/b?c=d#e",), ("no scheme/x y",), (None,), ("http://",)]
    got = [r[0] for r in spark.createDataFrame(urls, "u string").select(warc.url_key(__import__("pyspark").sql.functions.col("u"))).collect()]
    assert got == ["org,example,www)/a/b?c=d", "no%20scheme)/x%20y", ")", ")"]
