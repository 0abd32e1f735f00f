"""Queries over whole texts against plain loops."""

import re
import time

from pyspark.sql import functions as F

from orrery.functions import text
from orrery.plans import texts


def grams(text):
    x = f" {re.sub('[^a-z0-9]+', ' ', (text or '').lower()).strip()} "
    return {x[i : i + 3] for i in range(len(x) - 2)}


def test_trigram_dice_reads_whole_texts(spark, tmp_path):
    opening = "the same opening of two documents, longer than eighty characters, and so no prefix tells them apart; "
    rows = [(1, opening + "quick brown foxes jump"), (2, opening + "0123 zygote 4567 " * 40), (3, opening + "Quick-brown foxes"), (4, None), (5, ""), (9, opening)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["a"], r["b"]): r["dice"] for r in texts.QUERIES["trigram_dice_texts"](spark, str(tmp_path)).collect()}
    held, want = {k: grams(t) for k, t in rows}, {}
    for a in held:
        if a + 1 in held:
            x, y = held[a], held[a + 1]
            want[a, a + 1] = round(2 * len(x & y) / (len(x) + len(y)), 6) if x or y else 0
    assert got == want and got[1, 2] < 1


def test_trigrams_of_long_texts(spark):
    """Work grows with a text's length: sought from the text's start, these trigrams took minutes. Their order is the text's."""
    long = "abc0 " * 400_000 + "xyz"
    rows = spark.createDataFrame([(1, long), (2, "aba aba"), (3, ""), (4, None)], "i long, t string")
    began = time.time()
    got = {r["i"]: (r["g"], r["n"]) for r in rows.select("i", text.trigrams(F.col("t")).alias("g"), text.trigram_codes(F.col("t")).alias("n")).collect()}
    assert time.time() - began < 60
    assert got[1][0] == [" ab", "abc", "bc0", "c0 ", "0 a", "0 x", " xy", "xyz", "yz "] and got[2][0] == [" ab", "aba", "ba ", "a a"]
    assert got[3] == got[4] == ([], [])
    for g, n in got.values():
        assert sorted(ord(x[0]) * 16384 + ord(x[1]) * 128 + ord(x[2]) for x in g) == n


def test_a_text_is_folded_once_for_its_time(spark, tmp_path):
    spark.createDataFrame([(1, 1, "Hier à 5h30"), (1, 2, None)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = texts.QUERIES["time_resolution"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert {r["turn"]: (str(r["ts"]), r["uncertainty_min"]) for r in out.collect()} == {1: ("2024-01-30 05:30:00", 45), 2: ("None", None)}
