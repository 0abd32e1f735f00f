"""Names in texts: the longest match of a dictionary's phrases, and near misses of single words.

Phrases of a text are joined with the dictionary on the phrase itself, so that only hits are shuffled. Words are
compared with the dictionary once for each different word of the whole table, not once for each place they stand in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hit loses so much of its score for each edit.
PER_EDIT = 0.2


def edits_allowed(length: Column) -> Column:
    """None in short words, one up to eight letters, else two."""
    return F.when(length < 5, 0).when(length <= 8, 1).otherwise(2)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that lead from a to b, no letter edited twice;
    ``most + 1`` if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        earlier, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, earlier[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletions(word: Column, most: Column) -> Column:
    """The word, and what is left of it without one letter, or two, as far as ``most`` allows."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    own, one = F.array(word), F.array_distinct(less(word))
    two = F.array_distinct(F.flatten(F.transform(one, less)))
    return F.when(most <= 0, own).when(most == 1, F.concat(own, one)).otherwise(F.array_distinct(F.concat(own, one, two)))


def _near(words: DataFrame, keys: DataFrame) -> DataFrame:
    """word, ord, edits: the entity nearest to each of the words, if it is near enough; ties by the order of keys.

    An entity is looked at if any of its keys begins with the word's letter, then by all its keys of one word. Words that
    so many edits apart lie from a key leave the same letters when they lose as many, so the two meet in a join on what is
    left; only such pairs are measured, about as many as there are matches, whatever the size of the dictionary."""
    letters = keys.select(F.substring("key", 1, 1).alias("letter"), "ord").distinct()
    single = keys.where(~F.contains("key", F.lit(" ")) & (F.length("key") >= 4))  # shorter ones are near no word that may be edited
    index = single.select("key").distinct().select("key", F.explode(deletions(F.col("key"), F.lit(2))).alias("left"))
    asked = words.withColumn("most", edits_allowed(F.length("word"))).where("most > 0")
    met = asked.select("word", "most", F.explode(deletions(F.col("word"), F.col("most"))).alias("left")).join(index, "left").select("word", "most", "key").distinct()
    met = met.where(F.abs(F.length("word") - F.length("key")) <= F.col("most")).withColumn("letter", F.substring("word", 1, 1))
    pairs = met.join(single, "key").join(letters, ["ord", "letter"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["edits"] = [edits(a, b, m) for a, b, m in zip(x["word"], x["key"], x["most"], strict=True)]
            yield x.loc[x["edits"] <= x["most"], ["word", "ord", "n", "edits"]]

    found = pairs.select("word", "ord", "n", "key", "most").mapInPandas(measure, "word string, ord long, n long, edits int")
    return found.groupBy("word").agg(F.min(F.struct("edits", "ord", "n")).alias("m")).select("word", "m.ord", "m.edits")


def matches_in(texts: DataFrame, keys: DataFrame, words_col: str, fuzzy: bool = True) -> DataFrame:
    """``longest_matches`` for texts whose rows may repeat or have null ids: all columns of ``texts`` but the words, and
    the matches. Equal word arrays are searched once, under their hash, and every row gets the matches of its own."""
    hashed = texts.withColumn("_h", F.struct(F.xxhash64(words_col), F.xxhash64(words_col, F.lit(1))))
    once = hashed.groupBy("_h").agg(F.first(words_col).alias(words_col))
    return hashed.drop(words_col).join(longest_matches(once, keys, "_h", words_col, fuzzy), "_h").drop("_h")


def longest_matches(texts: DataFrame, keys: DataFrame, id_col: str, words_col: str, fuzzy: bool = True) -> DataFrame:
    """id, start, end (words, end exclusive), ord (the entity), score, phrase of every match.

    ``texts``: an id without repeats or nulls, and an array of folded words (null or empty: no match). ``keys``: ord (an
    entity's place in its dictionary), n (the key's place in its entity), key (folded words, joined by a blank); a key
    of several entities belongs to the first. Longer phrases go before shorter, then earlier before later; a word
    belongs to one match. A single word that no phrase takes may match with a few edits (see ``edits_allowed``). The
    matches of one text are chosen among that text's hits, the only thing gathered in one row.
    """
    keys = keys.where("key <> ''").select(F.col("ord").cast("long").alias("ord"), F.col("n").cast("long").alias("n"), "key")
    owners = keys.groupBy("key").agg(F.min("ord").alias("ord")).withColumn("span", F.size(F.split("key", " ")))
    spans = owners.agg(F.sort_array(F.collect_set("span")).alias("spans"))  # one row: the different lengths of phrases
    rows = texts.select(F.col(id_col).alias("_id"), F.col(words_col).alias("_w")).where(F.size("_w") > 0)
    starts = lambda n: F.when(n <= F.size("_w"), F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
    phrase = lambda n, i: F.struct(i.alias("start"), F.array_join(F.slice("_w", i + 1, n), " ").alias("key"))
    each = F.flatten(F.transform("spans", lambda n: F.transform(starts(n), lambda i: phrase(n, i))))
    phrases = rows.crossJoin(F.broadcast(spans)).select("_id", F.inline(each))  # one row of spans; a row leaves with its phrase alone
    hits = phrases.join(owners, "key").select("_id", "start", "span", "ord", F.lit(0).alias("edits"), F.col("key").alias("phrase"))
    if fuzzy:
        words = rows.select("_id", F.posexplode("_w").alias("start", "word"))
        near = _near(words.select("word").distinct().join(owners.select(F.col("key").alias("word")), "word", "left_anti"), keys)
        hits = hits.unionByName(words.join(near, "word").select("_id", "start", F.lit(1).alias("span"), "ord", "edits", F.col("word").alias("phrase")))
    one = F.struct((-F.col("span")).alias("minus"), "start", "span", "ord", "edits", "phrase")
    gathered = hits.groupBy("_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    kind = "array<struct<minus:int,start:int,span:int,ord:bigint,edits:int,phrase:string>>"

    def free(kept: Column, h: Column) -> Column:
        return ~F.exists(kept, lambda k: (k["start"] < h["start"] + h["span"]) & (h["start"] < k["start"] + k["span"]))

    # Hits of one word cannot overlap each other, so they are only held against the longer ones.
    longer = F.aggregate(F.filter("x", lambda h: h["span"] > 1), F.array().cast(kind), lambda kept, h: F.when(free(kept, h), F.array_append(kept, h)).otherwise(kept))
    chosen = gathered.select("_id", "x", longer.alias("longer"))
    chosen = chosen.select("_id", F.explode(F.concat("longer", F.filter("x", lambda h: (h["span"] == 1) & free(F.col("longer"), h)))).alias("h"))
    return chosen.select(
        F.col("_id").alias(id_col), F.col("h.start").alias("start"), (F.col("h.start") + F.col("h.span")).alias("end"), F.col("h.ord").alias("ord"),
        (1 - F.col("h.edits") * PER_EDIT).cast("double").alias("score"), F.col("h.phrase").alias("phrase"),
    )
