"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of doc_id (ties by size, then by checksum): a range partitioning, a number
within each partition, and the partitions' offsets. A balanced Feistel network on the smallest even number of bits
that holds the row count permutes the numbers; a result beyond the count is put through again until it falls within
(cycle walking), which keeps the map a bijection. Place p goes to shard p mod n, slot p div n: shard sizes
differ by at most one, slots have no gap, and any row's shard and slot can be computed from its number, the row
count and the seed alone, forwards and backwards.

Defined cases: a null text has size 8 and checksum 0, a very long one is measured whole; null doc_ids come first; rows alike
in doc_id, size and checksum are interchangeable, and the range partitioning splits them by their place in the
input; other columns are not read; an empty table gives no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.storage import checkpointed

SHARDS, SEED, ROUNDS = 24, 1, 6


def _round(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = half * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64((1 << bits) - 1)


def _keys(seed: int) -> list[int]:
    return [int(x) for x in np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, ROUNDS)]


def _half_bits(rows: int) -> int:
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, rows: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The place of each row number from 0 to rows - 1, or with inverse the row number at each place."""
    bits, keys = _half_bits(rows), _keys(seed)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.asarray(numbers, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for key in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ _round(left, key, bits), left
            else:
                left, right = right, left ^ _round(right, key, bits)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= rows]
    return out.astype(np.int64)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with row_number (long, from 0) in this order, without a global window."""
    # The input's own row id as the last key: rows alike in all others would be one range, however many.
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    sorted_ = tied.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    placed = checkpointed(sorted_.withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").withColumn("row_number", F.col("offset") + F.col("within")).drop("part", "within", "offset")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row of docs (doc_id, text)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(rows, "doc_id", "size", "text_crc32")
    total = rows.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed))

    placed = rows.withColumn("place", place("row_number"))
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").cast("long").alias("slot"))
