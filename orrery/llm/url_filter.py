"""URL lists: a blocked Bloom filter passes possible hits to an exact hash join that removes false positives.

The list holds canonical urls: a host in lower case and a path, without what follows ``?`` or ``#``. Whole canonical urls
go into the filter (``bloom.py``), and each distinct url of the table asks it once; what passes is joined with the list
on the whole url. So pairs are hits, whatever the number of pages of a site on either side.

Entries that stand for more than one url (rules, and sites as a whole) are apart. They fit their host and every
subdomain, where the path starts with theirs. A url's possible entries are the suffixes of its host with the beginnings
of its path, of as many labels and characters as entries have; those ask a filter of the whole entries, and are joined on
host and beginning. Of several fitting rules the longest wins; a url that no rule fits is blocked if it is listed or a
site fits it, else allowed.

A filter's blocks are dealt into parts of at most ``MAX_PART_BYTES``. One part is built in tasks and broadcast; of more,
each is built and asked in the task that its part's keys are shuffled to, so a list of any size has its filter and no
worker holds it all.

Defined results: a null url, or one without ``://``, has an empty host and path, fits nothing and is allowed; equal
rows get equal verdicts; urls of any length are read whole; an empty table or list gives an empty or all-allowed
result. An entry without a host fits nothing. Only the named id and url columns of the input are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from ._common import cut

#: A part of the filter that one worker holds.
MAX_PART_BYTES = 64 << 20
#: A key that many urls share is spread over so many tasks.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def beginnings(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """(host, path, key): the suffixes of a url's host, of so many labels at most, each with the beginnings of its path
    of the given lengths. ``urls``: host, path."""
    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda i: F.array_join(F.slice(names, -i, i), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    each = urls.select("host", "path", F.explode(suffixes).alias("suffix"))
    return each.select("host", "path", F.explode(F.transform(starts, lambda p: F.concat("suffix", p))).alias("key"))


def possible(keys: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """The rows of ``keys`` whose ``key`` a blocked Bloom filter of the entries' keys passes: all hits, and few others.
    ``entries``: key, of which there are ``n`` different ones."""
    blocks = bloom.n_blocks(n)
    parts = -(-blocks * bloom.BLOCK_BITS // 8 // MAX_PART_BYTES)
    columns, hashes = keys.columns, bloom.hashes(F.col("key"))
    if parts == 1:
        return bloom.sifted(keys, bloom.built(entries.select(*hashes), n), "key")
    each = -(-blocks // parts)
    part = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(parts)).cast("int").alias("part")
    salt = F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")
    listed = entries.select(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("asked"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in keys.schema], *hashes)
    asked = keys.select(part, salt, F.lit(1).alias("asked"), *columns, *hashes)
    by = ["part", "salt"]  # a hot key's urls meet its part in several tasks
    both = listed.unionByName(asked).repartition(parts * SALTS, *by).sortWithinPartitions(*by, "asked")  # entries come first

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, bloom.BlockedBloom(0)
        for b in batches:
            of, asked = b.column(0).to_numpy() * np.int64(SALTS) + b.column(1).to_numpy(), b.column(2).to_numpy() == 1
            h1, h2 = (b.column(i).to_numpy() for i in (len(columns) + 3, len(columns) + 4))
            ok = np.zeros(b.num_rows, bool)
            for p in np.unique(of):  # in the order of the rows
                if p != now:
                    now, own = p, bloom.BlockedBloom(each)
                own.add(h1[(of == p) & ~asked], h2[(of == p) & ~asked])
                ok[(of == p) & asked] = own.passes(h1[(of == p) & asked], h2[(of == p) & asked])
            yield pa.RecordBatch.from_arrays([b.column(i + 3) for i in range(len(columns))], names=columns).filter(pa.array(ok))

    return both.mapInArrow(sift, keys.schema)


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The urls (host, path) that are listed (host, path)."""
    keyed = lambda df: df.where("host <> ''").select("host", "path", F.concat("host", "path").alias("key"))  # noqa: E731  (a path is empty or begins with /)
    entries = cut(keyed(listed).select("key").distinct())
    return possible(keyed(urls), entries, entries.count()).join(entries, "key").select("host", "path")


def entry_hits(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """host, path, key, verdict of the entries (host, path, verdict) that fit the urls (host, path). An entry that many
    urls meet is read in several tasks."""
    held = cut(entries.where("host <> ''").select("host", F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict").distinct())
    keys = held.select("key").distinct()
    n, labels, lengths = held.agg(F.count_distinct("key"), F.max(F.size(F.split("host", r"\."))), F.sort_array(F.collect_set("n"))).first()
    if not n:
        return urls.limit(0).select("host", "path", F.lit("").alias("key"), F.lit(None).cast("string").alias("verdict"))
    hits = possible(beginnings(urls.where("host <> ''"), labels, lengths), keys, n)
    salted = held.select("key", "verdict").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).select("host", "path", "key", "verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, sites: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict for every row. ``rules``: host, path, verdict; ``sites``: host, path, blocked as
    a whole; ``listed``: host, path of canonical urls."""
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`"), host.alias("host"), path.alias("path"))
    urls = cut(rows.select("host", "path").distinct())
    none = F.lit(None).cast("string")
    fits = entry_hits(urls, rules.select("host", "path", "verdict").unionByName(sites.select("host", "path", none.alias("verdict"))))
    fits = fits.unionByName(listed_hits(urls, listed).select("host", "path", none.alias("key"), none.alias("verdict")))
    best = fits.groupBy("host", "path").agg(
        F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("key").alias("n"), "key", "verdict"))).alias("best"),
    )
    return rows.join(best.withColumn("hit", F.lit(True)), ["host", "path"], "left").select(
        f"`{key}`",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )
