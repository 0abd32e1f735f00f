import random
from collections import Counter

import pytest

from orrery.llm import url_filter as u

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.b.com", "", "block")]
SITES = [("bad.example.net", "/"), ("net", "/x")]
LISTED = [("notexample.org", "/en/12"), ("é.net", "/"), ("a.b.com", "/x"), ("", ""), ("com", "")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    at = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    rest = rest[at:]
    return host, rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]


def judge(url):
    host, path = split(url)
    fits = lambda h, p: host and (host == h or host.endswith("." + h)) and path.startswith(p)
    found = max((r for r in RULES if fits(*r[:2])), key=lambda r: len(r[0] + r[1]), default=None)
    if found:
        return host, path, found[0] + found[1], found[2]
    return host, path, None, "block" if any(fits(*x) for x in SITES) or (host and (host, path) in LISTED) else "allow"


def urls():
    rng = random.Random(6)
    hosts = ["example.org", "EXAMPLE.org", "x.example.org", "notexample.org", "org", "com", "a.b.com", "c.a.b.com", "bad.example.net", "www.bad.example.net", "é.net", "h" * 300 + ".com", ".".join("a" * 60) + ".org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/fr/", "/fr/#/es/", "?q://", "#f", "/x", "/" + "y" * 5000, "/fr/ü"]
    out = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    return out + [None, "", "no scheme", "http:/one", "a://b://c.org/", "http://u@example.org:80/es/"]


def lists(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string"), *(spark.createDataFrame(x, "host string, path string") for x in (SITES, LISTED))


def test_against_brute_force(spark):
    rows = list(enumerate(urls())) + [(None, "http://example.org/es/")] + [(1, urls()[1])] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict", "3 as key")
    out = u.judge_urls(pages, *lists(spark))
    assert Counter(map(tuple, out.collect())) == Counter((i, *judge(x)) for i, x in rows)


def test_without_a_filter_or_lists(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string")
    assert {r["verdict"] for r in u.judge_urls(pages, *(x.limit(0) for x in lists(spark))).collect()} == {"allow"}
    assert u.judge_urls(pages.limit(0), *lists(spark)).collect() == []
    monkeypatch.setattr(u, "MAX_PART_BYTES", 64)  # many parts of a block each
    assert Counter(map(tuple, u.judge_urls(pages, *lists(spark)).collect())) == Counter((i, *judge(x)) for i, x in enumerate(urls()))


@pytest.mark.parametrize("most", [64 << 20, 512], ids=["one part", "many parts"])
def test_a_list_of_thousands(spark, monkeypatch, most):
    """The filter passes every listed key and few others, and the verdicts are those of sets."""
    monkeypatch.setattr(u, "MAX_PART_BYTES", most)
    rng = random.Random(2)
    listed = [(f"{rng.choice('abc')}.site{i}.com", f"/p{i % 7}/") for i in range(3000)]
    urls = [f"https://{h.upper()}{p}?r" if i % 2 else f"https://{h}{p}other/" for i, (h, p) in enumerate(listed)] + ["https://site1.com/p1/", "https://com/"]
    pages, known = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), set(listed)
    none = [x.limit(0) for x in lists(spark)[:2]]
    got = {r["page_id"]: r["verdict"] for r in u.judge_urls(pages, *none, spark.createDataFrame(listed, "host string, path string")).collect()}
    assert all(got[i] == ("block" if split(url) in known else "allow") for i, url in enumerate(urls)) and "block" in got.values()
    entries = spark.createDataFrame([(f"{h}{p}",) for h, p in known], "key string")
    keys = spark.createDataFrame([(k,) for h, p in known for k in (f"{h}{p}", f"{h}/no/")], "key string")
    passed = [r["key"] for r in u.possible(keys, entries, len(known)).collect()]
    assert {f"{h}{p}" for h, p in known} <= set(passed) and len(passed) < 1.1 * len(known)
