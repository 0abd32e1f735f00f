"""WARC archives with a two-level capture index.

Each task writes one archive of gzip members, one a record, into a folder that all executors share; payloads of at
least ``DEDUP_BYTES`` that occur more than once are stored once, in the record with the largest id, and other records
revisit it. The index sorts captures by (reversed-host url key, id) and packs them into compressed blocks; a sparse
directory holds each block's first key. A lookup finds the block by binary search in the directory, reads that range,
searches it by bisection, and reads the record's range of the archive.

A task that fails or is repeated leaves files that no capture names; only what a committed task returned is used.

Defined results: a null payload is empty; a null id never wins a group that has other ids, and a group of null ids
alone has only responses; rows with the same id and payload are all responses; a null url has the key of an empty one;
payloads of any length are stored whole; an empty table gives empty archives and results. Only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, small_batches

DEDUP_BYTES = 1000
#: Shared digests that are broadcast, at most (of some 100 bytes).
BROADCAST_DIGESTS = 200_000
#: Bytes of records that a task reads back.
READ_BYTES = 32 << 20
BLOCK_LINES = 2048
#: A directory slice that is broadcast at a time; larger directories are searched slice by slice.
MAX_DIRECTORY_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = b"\r\n"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def own_file(where: str, kind: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path and name of a file that this attempt of this task alone writes."""
    store, top = open_folder(where)
    name = f"{kind}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
    store.create_dir(top, recursive=True)
    return store, f"{top}/{name}", name


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``com,example,www)/a?b``. Blanks are escaped."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20")
    rest = F.regexp_replace(plain, r"^[^:/?#]*://|#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?]*(.*)$", 1))


def sort_key(url: Column, key: Column) -> Column:
    """The index's key: url key and id, as text whose byte order is the order of the index."""
    number = (key.cast("decimal(20,0)") + F.expr("cast(9223372036854775808 as decimal(20,0))")).cast("decimal(20,0)").cast("string")
    return F.concat(url_key(url), F.lit(" "), F.coalesce(F.lpad(number, 20, "0"), F.lit("")))


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed. A revisit keeps the HTTP header, which states the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "" if key is None else key
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '%20', url or '')}",
        f"WARC-Payload-Digest: sha1:{b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + EOL * 2 + block + EOL * 2


class Parsed(NamedTuple):
    key: int | None
    url: str
    kind: str
    refers_to: int | None
    digest: str
    length: int
    payload: bytes | None


def parse(raw: bytes) -> Parsed:
    """Read a record back. A response's digest and length come from its payload; it must match its stated digest."""
    head, _, rest = raw.partition(EOL * 2)
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != EOL * 2:
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(EOL * 2)
    stated = hex_of(fields["WARC-Payload-Digest"])
    number = lambda s: int(s[10:-1]) if s and s != "<urn:page:>" else None
    of = (number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], number(fields.get("WARC-Refers-To")))
    if fields["WARC-Type"] == "revisit":
        length = next(int(x[16:]) for x in http.split(EOL) if x.lower().startswith(b"content-length: "))
        return Parsed(*of, stated, length, None)
    if (digest := hashlib.sha1(payload).hexdigest()) != stated:
        raise ValueError("a payload does not have its stated digest")
    return Parsed(*of, digest, len(payload), payload)


def hex_of(digest: str) -> str:
    from base64 import b32decode

    return b32decode(digest.removeprefix("sha1:")).hex()


def with_originals(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """id, url, payload (binary), keeper: the id whose record holds an equal payload, null where nothing is shared."""
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    shared = (
        rows.where(F.octet_length("payload") >= DEDUP_BYTES)
        .groupBy("digest")
        .agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("keeper").isNotNull())
        .drop("n")
    )
    shared = cut(shared)
    small = F.broadcast if shared.count() <= BROADCAST_DIGESTS else lambda df: df  # beyond, payloads are shuffled to theirs
    return rows.join(small(shared), "digest", "left").drop("digest")


def write_archives(pages: DataFrame, where: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all rows as WARC records under ``where``; the captures: k (index key), id, file, start, length."""
    rows = with_originals(pages, key, url, payload).withColumn("k", sort_key(F.col("url"), F.col("id")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = 0, None
        for b in batches:
            if out is None:
                store, path, name = own_file(where, "capture")
                name += ".warc.gz"
                out = store.open_output_stream(path + ".warc.gz", compression=None)
            ks, ids, starts, lengths = [], [], [], []
            for r in b.to_pylist():
                revisit = r["keeper"] is not None and r["id"] != r["keeper"]
                data = gzip.compress(record(r["id"], r["url"], r["payload"], r["keeper"], revisit), 6, mtime=0)
                out.write(data)
                ks.append(r["k"])
                ids.append(r["id"])
                starts.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.string()), pa.array(ids, pa.int64()), pa.array([name] * len(ks), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                names=["k", "id", "file", "start", "length"],
            )
        if out is not None:
            out.close()

    small_batches(pages.sparkSession)
    return cut(rows.select("id", "url", "payload", "keeper", "k").mapInArrow(write, "k string, id long, file string, start long, length long"))


class CaptureIndex:
    """Compressed blocks of index lines in ``where`` and their sparse directory: first, file, start, length."""

    def __init__(self, where: str, directory: DataFrame):
        self.where, self.directory = where, directory

    @staticmethod
    def build(captures: DataFrame, where: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, at, lines, first = None, 0, [], None
            entries = []

            def flush() -> None:
                nonlocal out, at, lines
                nonlocal name
                if out is None:
                    store, path, name = own_file(where, "index")
                    out = store.open_output_stream(path, compression=None)
                data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
                out.write(data)
                entries.append((first, name, at, len(data)))
                at, lines = at + len(data), []

            name = ""
            for b in batches:
                for k, file, start, length in zip(b["k"], b["file"], b["start"], b["length"], strict=True):
                    # a block never ends between equal keys: a lookup reads one block
                    if len(lines) >= block_lines and not lines[-1].startswith(f"{k}\t"):
                        flush()
                    if not lines:
                        first = k
                    lines.append(f"{k}\t{file}\t{start}\t{length}")
                if entries:
                    yield pd.DataFrame(entries, columns=["first", "file", "start", "length"])
                    entries = []
            if lines:
                flush()
            if out is not None:
                out.close()
            if entries:
                yield pd.DataFrame(entries, columns=["first", "file", "start", "length"])

        ordered = captures.select("k", "file", "start", "length").repartitionByRange("k").sortWithinPartitions("k")
        return CaptureIndex(where, cut(ordered.mapInPandas(pack, "first string, file string, start long, length long")))

    def slices(self, most: int = MAX_DIRECTORY_BYTES) -> Iterator[list[tuple[bytes, str, int, int]]]:
        """The directory in order of keys, in lists of at most about ``most`` bytes."""
        part, held = [], 0
        for r in self.directory.orderBy("first").toLocalIterator():
            size = len(r["first"]) + len(r["file"]) + 100
            if part and held + size > most:
                yield part
                part, held = [], 0
            part.append((r["first"].encode("utf-8", "surrogatepass"), r["file"], r["start"], r["length"]))
            held += size
        if part:
            yield part

    def locate(self, keys: DataFrame, most: int = MAX_DIRECTORY_BYTES) -> DataFrame:
        """All captures of the distinct keys ``k``: k, file, start, length. Each block is read in one task, once."""
        spark, where, found = keys.sparkSession, self.where, None
        keys = cut(keys.select("k").distinct())
        slices = self.slices(most)
        part, first = next(slices, None), True
        while part:  # this slice and the next are held
            after = next(slices, None)
            held = spark.sparkContext.broadcast(part)

            def to_block(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
                firsts = [x[0] for x in held.value]
                for b in batches:
                    at = [held.value[max(0, bisect.bisect_right(firsts, k.encode("utf-8", "surrogatepass")) - 1)] for k in b["k"]]
                    yield pd.DataFrame({"k": b["k"], "file": [x[1] for x in at], "start": [x[2] for x in at], "length": [x[3] for x in at]})

            own = keys
            if not first:
                own = own.where(F.col("k") >= part[0][0].decode("utf-8", "surrogatepass"))
            if after:
                own = own.where(F.col("k") < after[0][0].decode("utf-8", "surrogatepass"))
            at = own.mapInPandas(to_block, "k string, file string, start long, length long")
            found = at if found is None else found.unionByName(at)
            part, first = after, False
        kind = "k string, file string, start long, length long"
        if found is None:
            return spark.createDataFrame([], kind)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, top = open_folder(where)
            now, ks, lines = None, [], []
            for b in batches:
                out = []
                for k, file, start, length in zip(b["k"], b["file"], b["start"], b["length"], strict=True):
                    if (file, start) != now:
                        with store.open_input_file(f"{top}/{file}") as f:
                            data = zlib.decompress(f.read_at(length, start))
                        lines = [x.split(b"\t") for x in data.split(b"\n")]
                        now, ks = (file, start), [x[0] for x in lines]
                    key = k.encode("utf-8", "surrogatepass")
                    i = bisect.bisect_left(ks, key)
                    while i < len(ks) and ks[i] == key:
                        out.append((k, lines[i][1].decode(), int(lines[i][2]), int(lines[i][3])))
                        i += 1
                yield pd.DataFrame(out, columns=["k", "file", "start", "length"])

        return found.repartition("file", "start").sortWithinPartitions("file", "start", "k").mapInPandas(search, kind)


def fetch(captures: DataFrame, where: str, payload: bool = True) -> DataFrame:
    """Range-read the captures' records: id, url, record_type, refers_to, payload_digest, payload_bytes, and (if asked
    for) payload, which revisits leave null."""

    def pull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_folder(where)
        now, f = None, None
        for b in batches:
            got = []
            for file, start, length in zip(b["file"], b["start"], b["length"], strict=True):
                if file != now:
                    if f is not None:
                        f.close()
                    now, f = file, store.open_input_file(f"{top}/{file}")
                got.append(parse(gzip.decompress(f.read_at(length, start))))
            out = pd.DataFrame({"id": pd.array([x.key for x in got], "Int64"), "url": [x.url for x in got], "record_type": [x.kind for x in got]})
            out["refers_to"] = pd.array([x.refers_to for x in got], "Int64")
            out["payload_digest"], out["payload_bytes"] = [x.digest for x in got], [x.length for x in got]
            if payload:
                out["payload"] = [x.payload for x in got]
            yield out
        if f is not None:
            f.close()

    spark = captures.sparkSession
    small_batches(spark)
    captures = cut(captures.select("file", "start", "length"))
    size = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))  # by the records' bytes, not by the index's
    kind = "id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    near = captures.repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")
    return near.select("file", "start", "length").mapInPandas(pull, kind + (", payload binary" if payload else ""))
