"""Prefix trie of conversations, by distributed MSD radix partitioning.

A turn (role and text) becomes a number of a dictionary, so a conversation is a sequence of numbers, held as rows
(conversation, place, number), with a last row of number -1 where it ends; no row holds a whole conversation.

A bucket holds the conversations that begin alike up to some depth, and stands for that node of the trie. Each round
takes the buckets of more than ``LOCAL`` rows: a grouped count finds the place up to which all members agree (so a long
common run costs one round), the nodes up to there are emitted, and the numbers at that place deal the members into the
buckets of the next round. A bucket of one conversation is a chain, whose nodes its rows are. A smaller bucket is
finished in a task: multikey quicksort splits its members around a pivot number, those equal to it are a child, and the
recursion (over an explicit stack) emits the nodes. What nodes sum over their subtrees then goes up round by round.

A node is named by its smallest member and its depth. A hot number, bucket or conversation is met by rows in several
tasks (``look_up``). Only two things pass through one task as a stream, in bounded memory: the ids of the conversations
that end in one node, as SHA-256 takes them in order, and the depths of the common run of one bucket.

Defined results: a row without a conversation belongs to none; a null role or text is empty; turns of one number are
ordered by the hash of what they hold, equal ones count as often as they occur; a conversation may have no turns after
``rebuilt``, and then ends in the root; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ._common import cut, look_up, small_batches, written

#: Rows of a bucket that a task finishes.
LOCAL = 1 << 16
END = -1
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def encoded(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0, by turn), id (of role and text), bytes (of the text) of the turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    placed = cut(numbered(turns, ["conv"], ["turn", "digest"], "pos"))
    words = placed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id())
    return cut(look_up(placed, words, "digest", "n").select("conv", (F.col("pos") - 1).cast("long").alias("pos"), "id", "bytes"))


def rebuilt(turns: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Of every conversation: the first ``taken`` (at most ``most``) turns of its base, another conversation or itself,
    then its own turns after as many. conv, pos, id, bytes, len, with a row of id ``END`` at len."""
    heads = turns.where(F.col("pos") < most).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("head"))
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("base", base).withColumn("taken", taken)
    plan = own.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,id:bigint,bytes:bigint>>")), F.lit(1), F.col("taken").cast("int")))
    held = F.size("head").cast("long")
    plan = cut(plan.select("conv", "n", "taken", "head", held.alias("held"), (held + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("len")))
    first = plan.select("conv", F.inline("head"), "len")
    rest = look_up(turns, plan.select("conv", "n", "taken", "held", "len"), "conv", "n").where("pos >= taken")
    rest = rest.select("conv", (F.col("held") + F.col("pos") - F.col("taken")).alias("pos"), "id", "bytes", "len")
    ends = plan.select("conv", F.col("len").alias("pos"), F.lit(END).cast("long").alias("id"), F.lit(0).cast("long").alias("bytes"), "len")
    return first.select("conv", "pos", "id", "bytes", "len").unionByName(rest).unionByName(ends)


def ends_digest(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest() if convs else NOTHING


def finish(convs: list[int], ids: list[list[int]], sizes: list[list[int]], depth: int, parent: int | None, top_bytes: int) -> list[tuple]:
    """The nodes (as ``NODE``) of a bucket: conversations that agree up to ``depth``, by their numbers and bytes from
    there. Its own node comes first."""
    nodes: list[list] = []
    todo: list[tuple[int, list[int]]] = []  # a node, and members whose next numbers are not yet told apart

    def add(members: list[int], d: int, up: int | None, named: int | None, last: int) -> None:
        over = [m for m in members if len(ids[m]) == d]
        nodes.append([min(convs[m] for m in members), depth + d, named, len(members), 0, 0, (len(members) - 1) * last, ends_digest([convs[m] for m in over]), up])
        if len(over) < len(members):
            todo.append((len(nodes) - 1, [m for m in members if len(ids[m]) > d]))

    add(list(range(len(convs))), 0, None, parent, top_bytes)
    while todo:
        node, members = todo.pop()
        d = nodes[node][1] - depth
        pivot = ids[members[len(members) // 2]][d]
        less, equal, more = [], [], []
        for m in members:
            x = ids[m][d]
            (equal if x == pivot else less if x < pivot else more).append(m)
        todo += [(node, side) for side in (less, more) if side]
        nodes[node][4] += 1
        add(equal, d + 1, node, nodes[node][0], sizes[equal[0]][d])
    for x in reversed(nodes):
        x[5] = x[5] or 1
        if x[8] is not None:
            nodes[x[8]][5] += x[5]
            nodes[x[8]][6] += x[6]
    return [tuple(x[:8]) for x in nodes]


def finished(rows: DataFrame) -> DataFrame:
    """``NODE``s of buckets (b, s, up, top_bytes, conv, pos, id, bytes) of at most ``LOCAL`` rows."""
    columns = ["b", "s", "up", "top_bytes", "conv", "pos", "id", "bytes"]
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(t: pa.Table, starts: list[int]) -> pa.RecordBatch:
            out: list[tuple] = []
            x = {c: t.column(c).to_pylist() for c in columns}
            for i, j in zip(starts, [*starts[1:], t.num_rows], strict=True):
                convs, ids, sizes = [], [], []
                for k in range(i, j):
                    if not convs or convs[-1] != x["conv"][k]:
                        convs.append(x["conv"][k])
                        ids.append([])
                        sizes.append([])
                    if x["id"][k] != END:
                        ids[-1].append(x["id"][k])
                        sizes[-1].append(x["bytes"][k])
                out += finish(convs, ids, sizes, x["s"][i], x["up"][i], x["top_bytes"][i])
            return pa.RecordBatch.from_pylist([dict(zip(names, n, strict=True)) for n in out], schema=schema)

        schema = pa.schema([(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in names])
        left: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t])
            bucket = t.column("b").to_numpy()
            starts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist()]
            if len(starts) > 1:
                yield nodes(t.slice(0, starts[-1]), starts[:-1])
            left = t.slice(starts[-1])
        if left is not None and left.num_rows:
            yield nodes(left, [0])

    return rows.select(*columns).repartition("b").sortWithinPartitions("b", "conv", "pos").mapInArrow(run, NODE)


def chains(rows: DataFrame) -> DataFrame:
    """``NODE``s of buckets of one conversation: that of the bucket, from the row where it ends, and one of each turn."""
    last, top = F.col("id") == END, F.col("s")
    depth = F.when(last, top).otherwise(F.col("pos") + 1)
    over = depth == F.col("len")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return rows.select(
        F.col("conv").alias("conv_id"), depth.alias("depth"), F.when(last, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(over, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(over, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )


def digested(ends: DataFrame) -> DataFrame:
    """b, ends_sha256 of rows (b, conv): ids are hashed as they come, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, digest = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, str]] = []
            for b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if bucket is not None:
                        out.append((bucket, digest.hexdigest()))
                    bucket, digest = b, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string()))], names=["b", "ends_sha256"])
        if bucket is not None:
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([digest.hexdigest()])], names=["b", "ends_sha256"])

    return ends.select("b", "conv").repartition("b").sortWithinPartitions("b", "conv").mapInArrow(run, "b long, ends_sha256 string")


def split(big: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of large buckets (rows with n, their members): the common run (b, depth, bytes; from the bucket's own node), the
    buckets (b, s, e, n, up, ends_sha256: the run ends at depth e), their children (b, child), and the rows of these."""
    places = cut(big.groupBy("b", "pos").agg(F.count(F.lit(1)).alias("here"), F.min("id").alias("low"), F.max("id").alias("high"), F.first("bytes").alias("bytes"), F.first("n").alias("n")))
    common = (F.col("here") == F.col("n")) & (F.col("low") == F.col("high")) & (F.col("low") != END)
    until = places.groupBy("b").agg(F.min(F.when(~common, F.col("pos"))).alias("e"), F.sum("here").alias("_rows"))
    at = cut(look_up(big, until, "b", "_rows").drop("_rows"))
    here = at.where("pos = e")
    kids = here.where(F.col("id") != END).withColumn("key", F.concat_ws(":", "b", "id"))
    kinds = cut(kids.groupBy("key").agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("_n"), F.first("b").alias("b"), F.first("bytes").alias("child_bytes")))
    dealt = look_up(kids.select("key", "conv", F.col("b").alias("above"), (F.col("e") + 1).alias("below"), (F.col("len") - F.col("e")).alias("_rows")), kinds.drop("b"), "key", "_n")
    rows = look_up(at.where("pos > e").select("conv", "pos", "id", "bytes", "len"), dealt.select("conv", "above", "below", "child", "child_bytes", "_rows"), "conv", "_rows")
    own = here.groupBy("b").agg(*[F.first(c).alias(c) for c in ("s", "e", "n", "up", "top_bytes")])
    buckets = cut(own.join(digested(here.where(F.col("id") == END)), "b", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))))
    run = places.join(buckets.select("b", "e"), "b").where("pos < e").select("b", (F.col("pos") + 1).alias("depth"), "bytes")
    run = run.unionByName(buckets.select("b", F.col("s").alias("depth"), F.col("top_bytes").alias("bytes")))
    below = rows.select(F.col("child").alias("b"), F.col("below").alias("s"), F.col("above").alias("up"), F.col("child_bytes").alias("top_bytes"), "conv", "pos", "id", "bytes", "len")
    return run, buckets, kinds.select("b", "child"), below


def upper(run: DataFrame, buckets: DataFrame, children: DataFrame, below: DataFrame) -> DataFrame:
    """``NODE``s of the common runs of large buckets, from those of the buckets below them."""
    of = below.select(F.col("conv_id").alias("child"), F.col("depth").alias("child_depth"), "n_leaves", "saved_tokens")
    tops = children.join(buckets.select("b", "e"), "b").join(of, "child").where("child_depth = e + 1")
    sums = tops.groupBy("b").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    whole = buckets.drop("top_bytes").join(sums, "b", "left")
    deepest = F.sum(F.col("bytes") * (F.col("n") - 1)).over(Window.partitionBy("b").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    nodes = run.join(whole, "b")
    last = F.col("depth") == F.col("e")
    return nodes.select(
        F.col("b").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("s"), F.col("up")).otherwise(F.col("b")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (deepest + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(NOTHING).alias("ends_sha256"),
    )


def trie(rows: DataFrame, local: int | None = None) -> DataFrame:
    """``NODE``s of the trie of ``rows`` (as ``rebuilt`` returns them)."""
    local, none = local or LOCAL, F.lit(None).cast("long")
    small_batches(rows.sparkSession, 1 << 16)
    now = written(rows, "trie")
    root = now.agg(F.min("conv")).first()[0]
    now = now.select(F.lit(root).cast("long").alias("b"), F.lit(0).cast("long").alias("s"), none.alias("up"), F.lit(0).cast("long").alias("top_bytes"), *now.columns)
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    done: list[DataFrame] = []
    while root is not None:
        sizes = now.groupBy("b").agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col("id") == END, 1)).alias("n"))
        sized = cut(look_up(now, sizes, "b", "_rows"))
        small = F.col("_rows") <= local
        done.append(cut(chains(sized.where("n = 1")).unionByName(finished(sized.where((F.col("n") > 1) & small)))))
        big = sized.where((F.col("n") > 1) & ~small).drop("_rows")
        if big.isEmpty():
            break
        *above, now = split(big)
        now = written(now, "trie")
        rounds.append(tuple(above))
    below = done.pop() if done else rows.sparkSession.createDataFrame([], NODE)
    nodes = below
    while rounds:
        below = cut(upper(*rounds.pop(), below)).unionByName(done.pop())
        nodes = nodes.unionByName(below)
    return nodes
