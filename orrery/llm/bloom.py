"""Blocked Bloom filters: a key has one block of 512 bits, a cache line, and ``PROBES`` bits in it.

A filter is built in tasks: keys are shuffled by the slice of blocks that they fall into, a task sets the bits of its
slices, and the driver puts slices side by side. Callers bound the filter's size before they build and broadcast it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
PROBES = 7
BLOCK_BITS = 512
#: Blocks of a slice.
SLICE = 1 << 13


def hashes(*key: Column) -> list[Column]:
    """Two 64-bit hashes of a key: the first names its block, the second its bits."""
    return [F.xxhash64(*key).alias("h1"), F.xxhash64(*key, F.lit(1)).alias("h2")]


def n_blocks(n: int) -> int:
    return max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))


def places(h1: np.ndarray, h2: np.ndarray, blocks: int) -> Iterator[np.ndarray]:
    """The places of the keys' bits among all bits, probe by probe."""
    first = np.mod(h1, blocks) * BLOCK_BITS
    for i in range(PROBES):
        yield first + ((h2.view(np.uint64) >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


class BlockedBloom:
    def __init__(self, blocks: int, bits: np.ndarray | None = None):
        self.blocks = blocks
        self.bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8) if bits is None else bits

    def add(self, h1: np.ndarray, h2: np.ndarray) -> BlockedBloom:
        for at in places(h1, h2, self.blocks):
            np.bitwise_or.at(self.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return self

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for at in places(h1, h2, self.blocks):
            ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


def built(keys: DataFrame, n: int) -> BlockedBloom:
    """The filter of ``keys`` (h1, h2), of which there are about ``n``."""
    blocks = n_blocks(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(0, bool)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["slice", "bits"])

        for b in batches:
            of, h1, h2 = (c.to_numpy() for c in b.columns)
            for s in np.unique(of):  # rows come sorted by slice
                if s != now:
                    if now is not None:
                        yield out()
                    now, bits = int(s), np.zeros(min(SLICE, blocks - int(s) * SLICE) * BLOCK_BITS, bool)
                for at in places(h1[of == s], h2[of == s], blocks):
                    bits[at - now * SLICE * BLOCK_BITS] = True
        if now is not None:
            yield out()

    of = F.floor(F.pmod("h1", F.lit(blocks)) / SLICE).cast("long").alias("slice")
    slices = keys.select(of, "h1", "h2").repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice long, bits binary").toArrow()
    bloom = BlockedBloom(blocks)
    for s, bits in zip(*(slices.column(i).to_pylist() for i in range(2)), strict=True):
        bloom.bits[s * SLICE * BLOCK_BITS // 8 :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return bloom


def sifted(rows: DataFrame, bloom: BlockedBloom, *key: str) -> DataFrame:
    """The rows whose key the filter passes: all that it holds, and few others. Only hashes go to Python."""
    held = rows.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def passes(h1, h2):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(held.value.passes(h1.to_numpy(), h2.to_numpy()))

    return rows.where(passes(*hashes(*[F.col(k) for k in key])))
