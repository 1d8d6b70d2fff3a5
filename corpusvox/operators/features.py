"""Embedding and feature statistics.

Element-wise statistics go through ``posexplode`` + ``groupBy(key, dim)``:
partial aggregation on the map side means a speaker with a third of all
utterances contributes one partial row per task and dimension, never one
hot reducer holding its vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusvox.functions.vectors import sq_distance

#: Centroid values that become one plan literal; a larger codebook takes several.
BLOCK_VALUES = 1_000_000


def explode_dims(df: DataFrame, keys, vec: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys, F.posexplode(vec).alias("dim", "x"))


def elementwise_mean(df: DataFrame, key: str, vec: str) -> DataFrame:
    """A1/A20 long form: (key, dim, mean) in DOUBLE."""
    return explode_dims(df, key, vec).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def assemble_vectors(long: DataFrame, key: str, value: str = "mean", name: str = "vec") -> DataFrame:
    """(key, dim, value) -> (key, ARRAY) in dimension order; a vector is bounded by its dim."""
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", value))).alias("_v")) \
        .select(key, F.transform("_v", lambda s: s[value]).alias(name))


def global_cmvn(df: DataFrame, vec: str) -> DataFrame:
    """Per dim frames, sum, sum of squares, shift = -mean, scale = 1/sqrt(E[x^2] - mean^2)."""
    s = explode_dims(df, [], vec).groupBy("dim").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.col("x").cast("double")).alias("sum_x"),
        F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("sum_x2"))
    mean = F.col("sum_x") / F.col("frames")
    return s.withColumn("shift", -mean) \
            .withColumn("scale", 1.0 / F.sqrt(F.col("sum_x2") / F.col("frames") - mean * mean))


def cmvn_vectors(stats: DataFrame) -> tuple[list[float], list[float]]:
    """The (shift, scale) vectors of A14, collected: one value per feature dimension."""
    rows = stats.select("dim", "shift", "scale").orderBy("dim").collect()
    return [r["shift"] for r in rows], [r["scale"] for r in rows]


def nearest_centroid(df: DataFrame, vec: str, centroids: DataFrame, cid: str = "cid",
                     cvec: str = "vec", out: str = "centroid") -> DataFrame:
    """Index of the closest centroid (Euclidean); lowest index wins a tie.

    The codebook is counted first and cut into blocks of BLOCK_VALUES values (in expectation);
    each block is collected on its own and embedded as a literal, so the data side never
    shuffles and is scanned once, and the best over the blocks wins."""
    n, dim = centroids.agg(F.count(F.lit(1)), F.max(F.size(cvec))).first()
    if not n:
        raise ValueError("no centroids")
    n_blocks = -(-n * dim // BLOCK_VALUES)
    best = []
    for block in range(n_blocks):
        part = centroids.where(F.pmod(F.xxhash64(cid), F.lit(n_blocks)) == block) if n_blocks > 1 else centroids
        rows = part.select(cid, cvec).orderBy(cid).collect()
        if rows:
            cents = F.array(*[F.struct(F.lit(r[cid]).alias("id"), F.array(*[F.lit(float(v)) for v in r[cvec]]).alias("v"))
                              for r in rows])
            best.append(F.array_min(F.transform(cents, lambda c: F.struct(
                sq_distance(F.col(vec), c["v"]).alias("d"), c["id"].alias("id")))))
    nearest = F.least(*best) if len(best) > 1 else best[0]
    return df.withColumn(out, nearest["id"])
