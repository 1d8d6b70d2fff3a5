"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of given columns; the permutation maps a number to a
position, and position p goes to shard ``p % shards``, slot ``p // shards``.  Shard sizes
differ by one at most, slots have no gaps, and anyone who knows N, the seed and a row's
number can compute its place without the table.

Defined results: nulls sort first; rows equal in all order columns are interchangeable, so
the result as a whole does not depend on which of them comes first; an empty table gives an
empty result; the result has the order columns and the four new ones, nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvox.llm.common import free_name, quoted, shuffle_partitions
from corpusvox.session import cut_lineage

ROUNDS = 6


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mix of each value with a round key."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def round_keys(seed: int) -> list[int]:
    return [int(k) for k in mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64), (seed * 0xD1342543DE82EF95 + 1) % 2**64)]


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The image of each number under the keyed permutation of 0..n-1.

    The network permutes the least even-bit power of two not below n (under 4n); a value that
    falls outside walks on along its cycle until it is back inside."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = round_keys(seed)
    out = numbers.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for key in keys:
            left, right = right, left ^ (mixed(right, key) & mask)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a gapless global row number by ``order``, without a one-task window.

    A range sort puts the rows in order over many tasks; the sorted rows are checkpointed, so
    that a lost executor cannot renumber them, and each task's count gives the next one's
    offset.  Ties are spread by their place in the input."""
    spark = df.sparkSession
    tie, part, first = free_name(df, "_tie"), free_name(df, "_part"), free_name(df, "_first")
    keys = [F.col(quoted(c)) for c in order] + [F.col(tie)]
    sorted_rows = cut_lineage(df.withColumn(tie, F.monotonically_increasing_id())
                              .repartitionByRange(shuffle_partitions(spark), *keys)
                              .sortWithinPartitions(*keys).drop(tie))
    counts = {r[0]: r[1] for r in sorted_rows.groupBy(F.spark_partition_id()).count().collect()}
    rows, total = [], 0
    for p in sorted(counts):
        rows.append((p, total))
        total += counts[p]
    offsets = spark.createDataFrame(rows, f"{part} int, {first} long")
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (sorted_rows.withColumn(part, F.spark_partition_id()).withColumn(name, in_part)
            .join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(first)).drop(part, first))


def position(number: Column, n: int, seed: int) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def place(a: pa.Array) -> pa.Array:
        return pa.array(permuted(a.to_numpy(zero_copy_only=False), n, seed), type=pa.int64())
    return place.asNondeterministic()(number)


def assign_shards(df: DataFrame, order: list[str], shards: int, seed: int = 42) -> DataFrame:
    """The order columns of ``df`` with row_number, position, shard and slot."""
    light = cut_lineage(df.select(*[F.col(quoted(c)) for c in order]))
    n = light.count()
    rows = numbered(light, order, "row_number")
    return (rows.withColumn("position", position(F.col("row_number"), n, seed))
            .withColumn("shard", (F.col("position") % shards).cast("int"))
            .withColumn("slot", F.expr(f"position div {int(shards)}")))
