"""Bloom filters over 64-bit hashes: put together by Spark in blocks, tested in Arrow batches.

A task sends the blocks of bits that its hashes set, not the hashes; a filter has at most ``MAX_BITS`` bits, whatever goes into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 32 MB; a filter of more than ``MAX_BITS / PER_HASH`` hashes lets more through, one of many more than that all.
MAX_BITS = 1 << 28
PER_HASH = 16
#: Bits of a block: what ``bitmap_construct_agg`` holds.
BLOCK = 1 << 15


def bits_for(hashes: int) -> int:
    """A power of two."""
    return min(MAX_BITS, max(BLOCK, 1 << (PER_HASH * hashes).bit_length()))


def build(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter of a column of hashes, as bytes: two bits for each."""
    low, high = F.col(column).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(bits - 1))
    places = hashes.select(F.explode(F.array(low, high)).alias("place"))
    blocks = places.groupBy(F.shiftright("place", 15).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(BLOCK - 1))).alias("bits"))
    out = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for r in blocks.toLocalIterator():  # bits / BLOCK rows at most
        out[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def holds(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some hashes may be in a filter."""
    mask, found = np.int64(len(bloom) * 8 - 1), None
    for place in (hashes & mask, (hashes >> 32) & mask):
        bit = (bloom[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        found = bit if found is None else found & bit
    return found.astype(bool)


def suspected(spark: SparkSession, bloom: np.ndarray, hashes: Column) -> Column:
    """Of arrays of hashes what may be in the filter, which is broadcast."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.arrow_udf("array<long>")
    def kept(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(column.offsets.to_numpy()))
            good = holds(shared.value, values)
            counts = np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], ends])]
            yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(values[good]))

    return kept(hashes)
