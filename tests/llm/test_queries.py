"""The registered corpus queries over the smallest tables, against their SQL, and all of them over empty tables and
over tables with repeated rows, nulls and other columns."""

import pytest

from orrery.llm import queries

from ..oracle import connect, differences

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLES[name]) == []


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables of a few odd rows, and without rows."""
    where = tmp_path_factory.mktemp("odd")
    prose = "the quick brown fox jumps over the lazy dog and then it sleeps for a while under the old oak tree " * 3
    docs = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, prose, "en", None, 9), (2, prose, "en", None, 9), (3, prose + "x", None, "b", 9), (4, "é " * 5000, "fr", "b", 9)]
    pages = [(None, None, None), (1, "http://a.example.org/es/x", "<p>***"), (1, "http://a.example.org/es/x", "<p>***"), (2, "no url", "p" * 1500), (3, "https://b.com", "p" * 1500)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 as size", "8 as shard", "9 as fp", "1 as findings"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule", "3 as k"),
        "benchmark": spark.createDataFrame([(None, None), (1, prose), (2, "")], "item_id long, text string"),
        "labels": spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"),
        "conversations": spark.createDataFrame([(None, 1, "user", "hi"), (1, None, None, None), (1, 0, "user", "é" * 9000), (1, 0, "user", "é" * 9000), (2, 0, "user", "hi")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as id"),
        "embeddings": spark.createDataFrame([(None, None), (None, [0.5] * 64), (1, [0.1] * 64), (1, [0.1] * 64), (2, [None] * 64), (3, [0.1])], "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{where}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{where}/none/{name}.parquet")
    return {"odd": f"{where}/odd", "none": f"{where}/none"}


#: Rows of the odd tables that a query returns.
ROWS = {"op3_warc": 5, "op6_url_filter": 5, "op7_language_id": 11, "op10_decontaminate": 3, "op11_prefix_trie": 2, "op13_centroids": 3}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, odd, name):
    assert queries.QUERIES[name](spark, odd["odd"]).count() == ROWS.get(name, 6)
    assert queries.QUERIES[name](spark, odd["none"]).collect() == []
