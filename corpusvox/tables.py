"""Access to the parquet tables the library runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read a table.  With ``spread``, a table that Spark reads in fewer tasks than the cluster
    has cores is spread round-robin first, so heavy per-row work (tokenizing whole texts) uses
    every core; inputs of many row groups never trigger it.  Off by default: for light per-row
    work the extra shuffle costs more."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
