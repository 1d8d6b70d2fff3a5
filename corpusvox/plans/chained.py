"""Sequential folds over hot sessions, cut into buckets that run beside each other.

A fold that cannot be written as a window (a state machine with counters, buffers and look-back)
is run bucket by bucket: ``range_buckets`` cuts each key's order into buckets, and every bucket
maps an entry state to an exit state and its outputs.  All buckets run at once, each from the
state it would have if nothing of importance came before it.  Then the maps are chained: a bucket
whose entry differs from the exit of the bucket before runs again from that exit, and so on
until every bucket started from the state that its predecessor ended in.  The first bucket of a
key starts right, so each round settles at least one more bucket, and the result is always that
of the sequential fold; state machines forget (a segment closes, a sentence ends), so nearly all
buckets settle in the first rounds, whatever the length of the session.

A fold is an object with

* ``guess(offset)`` -- the entry state of a bucket whose first row has this number (0: the true start);
* ``run(state, batches, last)`` -- ``(exit state, output tuples, count)`` over the rows of a bucket,
  given as pandas batches in order; ``last`` says that the session ends with it;
* ``fields`` -- the output columns as DDL.

States are tuples of JSON values in a normal form: two states that behave alike must be equal, or
buckets run again for nothing.  ``count`` is summed over the buckets before (``_before``), so that
outputs can be numbered through without a number in the state.  A bucket's outputs and state are
held by one task; nothing else is, and per key only one light row a bucket is ordered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusvox.plans.sequence import B, DEFAULT_ROWS_PER_BUCKET, _null_safe_join, has_hot_key, is_small, one_bucket, range_buckets
from corpusvox.session import cut_lineage


def chained_fold(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], fold,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """(key, _before, *fold.fields): the outputs of ``fold`` over the rows of each key in order.

    ``key`` is a long column (null: a key of its own); ``_before`` is the sum of the counts of the
    key's earlier buckets."""
    order, values = list(order), list(values)
    rows = df.select(F.col(key).cast("long").alias("_key"), *order, *values)
    if rows_per_bucket is None and (is_small(rows) or not has_hot_key(rows, ["_key"], order, DEFAULT_ROWS_PER_BUCKET)):
        rows = one_bucket(rows)
    else:
        rows = range_buckets(rows, ["_key"], order, rows_per_bucket or DEFAULT_ROWS_PER_BUCKET)
    rows = cut_lineage(rows)
    chain = Window.partitionBy("_key").orderBy(B)
    sizes = cut_lineage(rows.groupBy("_key", B).agg(F.count("*").alias("n")))
    starts = sizes.select("_key", B, (F.sum("n").over(chain) - F.col("n")).alias("offset"),
                          F.lead(B).over(chain).isNull().alias("last"))
    guess = F.udf(lambda offset: json.dumps(fold.guess(offset)), "string")
    todo = cut_lineage(starts.select("_key", B, "last", guess("offset").alias("entry")))
    results = None
    schema = f"_key long, {B} long, last boolean, entry string, exit string, n long, out array<struct<{_struct(fold.fields)}>>"
    names = [f.split(":")[0] for f in _struct(fold.fields).split(",")]
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    heads = ["_key", B, "last", "entry"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Runs of rows of one bucket; a bucket's runs follow each other."""
        for b in batches:
            if b.num_rows:
                key = b.column(b.schema.get_field_index("_key")).dictionary_encode(null_encoding="encode").indices.to_numpy()
                bucket = b.column(b.schema.get_field_index(B)).to_numpy()
                cuts = (np.flatnonzero((np.diff(key) != 0) | (np.diff(bucket) != 0)) + 1).tolist()
                for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                    part = b.slice(lo, hi - lo)
                    yield tuple(part.column(part.schema.get_field_index(c))[0].as_py() for c in heads), part.select([*order, *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, bucket, last, entry), parts in groupby(pieces(batches), key=lambda x: x[0]):
            end, out, n = fold.run(json.loads(entry), (p.to_pandas() for _, p in parts), last)
            row = {"_key": key, B: bucket, "last": last, "entry": entry, "exit": json.dumps(end), "n": n,
                   "out": [dict(zip(names, map(_plain, o), strict=True)) for o in out]}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    while True:
        work = _null_safe_join(rows, todo, ["_key", B], "inner").repartition("_key", B).sortWithinPartitions("_key", B, *order)
        new = work.mapInArrow(run, schema)
        if results is not None:
            kept = _null_safe_join(results, todo.select("_key", B, F.lit(True).alias("again")), ["_key", B]).where("again IS NULL")
            new = kept.drop("again").select(*results.columns).unionByName(new)
        results = cut_lineage(new)
        before = F.lag("exit").over(chain)
        todo = cut_lineage(results.select("_key", B, "last", "entry", before.alias("right")).where(
            "right IS NOT NULL AND right <> entry").select("_key", B, "last", F.col("right").alias("entry")))
        if not todo.limit(1).count():
            break
    numbered = results.withColumn("_before", F.sum("n").over(chain) - F.col("n"))
    return numbered.select(F.col("_key").alias(key), "_before", F.inline("out"))


def _plain(x: Any) -> Any:
    """A numpy number as Python's."""
    return x.item() if isinstance(x, np.generic) else x


def _struct(ddl: str) -> str:
    """``a long, b string`` as the inside of a struct type."""
    return ",".join(":".join(part.split()) for part in ddl.split(","))
