"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpusvox.session import ship_package

#: Arrow batches handed to Python: rows and bytes, so that long texts stay bounded in memory.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

#: A side of a join is broadcast up to this many rows of bounded width, and joined by shuffle beyond.
BROADCAST_ROWS = 4096


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors and bound the Arrow batches of this session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_udf(make: Callable[[], Callable[[list], list]], schema: StructType, n_args: int = 1):
    """A scalar Arrow UDF that returns ``schema`` as a struct.

    ``make()`` runs once per Python worker call and gives ``f(*lists) -> list of tuples``; the
    lists hold the values of one Arrow batch.  The UDF counts as non-deterministic for the
    optimizer, so that a later filter on one of its fields does not evaluate it a second time."""
    from pyspark.sql.functions import arrow_udf

    names = [f.name for f in schema.fields]
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def struct_of(rows: list) -> pa.Array:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names)

    if n_args == 1:
        @arrow_udf(schema)
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            f = make()
            for a in batches:
                yield struct_of(f(a.to_pylist()))
        return one.asNondeterministic()

    @arrow_udf(schema)
    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = make()
        for arrays in batches:
            yield struct_of(f(*(a.to_pylist() for a in arrays)))
    return many.asNondeterministic()


def with_fields(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """Append the fields ``names`` of ``struct``; columns of ``df`` with those names are replaced."""
    tmp = free_name(df, "_fields")
    out = df.withColumn(tmp, struct)
    taken = {n.lower() for n in names} | {tmp.lower()}
    kept = [F.col(quoted(c)) for c in out.columns if c.lower() not in taken]
    return out.select(*kept, *[F.col(quoted(tmp))[n].alias(n) for n in names])


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, made longer until no column of ``df`` has that name."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rows_per_part(n_rows: int, per_part: int, least: int) -> int:
    """Partitions so that each holds about ``per_part`` rows, ``least`` at least."""
    return max(least, -(-n_rows // per_part))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
