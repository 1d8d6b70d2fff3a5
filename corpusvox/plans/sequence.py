"""Ordered-sequence primitives that stay parallel when one key is hot.

A window ``partitionBy(session).orderBy(t)`` puts a whole session in one task;
if one session holds a third of the rows, one task does a third of the work.
These helpers cut the order of ``(keys..., order...)`` into buckets, run the
window inside ``(keys, bucket)``, and repair the bucket edges with a small
per-``(key, bucket)`` carry table:

* ``seq_lag`` / ``seq_lead`` -- previous / next row's values
* ``seq_cumsum``             -- running sums (row numbers are running counts)
* ``seq_cummin``             -- least value so far
* ``seq_ffill``              -- last non-NULL value so far

Buckets begin at sampled rows: a hash of the key and the whole sort key picks
``OVERSAMPLE`` rows a bucket, and every ``OVERSAMPLE``-th of a key's sorted
picks is a bound.  So bounds are quantiles of the data itself: outliers, shared
prefixes and ties in the first order columns do not fill a bucket, and there is
no greatest number of buckets.  A NULL key is a key like any other, and NULL
order values sort first.  The bounds of a global order (no key) are a scalar subquery.  A table
that the optimizer estimates at under ``corpusvox.seq.wholeBytes`` is left whole, and the helpers
are then plain windows.  So is a larger one none of whose keys fills a bucket, which one job over
the picked rows' keys tells (``has_hot_key``): many small keys cost one shuffle, not carry tables
with a row a key.  All else is lazy.

The carry tables hold one row per (key, bucket), so their size is about
``#keys + rows / rows_per_bucket`` and never the rows of a hot key.  They read
the same shuffle as the rows they repair (see ``_edge_rows``).  The order passed
in must be total (add a unique tie-break column) for results to be deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

B = "_seq_b"
#: Tables that Spark estimates at fewer bytes are not cut: each key is one bucket.
WHOLE_BYTES_CONF = "corpusvox.seq.wholeBytes"
DEFAULT_WHOLE_BYTES = 64 << 20
WHOLE = {"corpusvox.whole": True}
ROWS_PER_BUCKET_CONF = "corpusvox.seq.rowsPerBucket"
DEFAULT_ROWS_PER_BUCKET = 200_000
#: Picked rows for each bucket; more make the buckets more even.
OVERSAMPLE = 32


def _names(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _bounds_upto(bounds: Column, key: Column) -> Column:
    """How many entries of a sorted array are at or below ``key``: a binary search, bit by bit."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), lambda x: x <= F.size(bounds))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, a NULL being equal to a NULL; the right side's keys are dropped."""
    names = {k: f"_seq_key{i}" for i, k in enumerate(keys)}
    right = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    on = F.lit(True)
    for k, n in names.items():
        on = F.col(k).eqNullSafe(F.col(n)) & on if k != keys[0] else F.col(k).eqNullSafe(F.col(n))
    return left.join(right, on, how).drop(*names.values())


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate, which runs no job, lets every key stay in one bucket."""
    limit = int(df.sparkSession.conf.get(WHOLE_BYTES_CONF, str(DEFAULT_WHOLE_BYTES)))
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < limit


def one_bucket(df: DataFrame) -> DataFrame:
    """Add ``_seq_b`` = 0, marked so that nothing is carried between buckets."""
    return df.withColumn(B, F.lit(0).cast("long")).withMetadata(B, WHOLE)


def is_whole(df: DataFrame) -> bool:
    """Whether the table, which has ``_seq_b``, was left whole."""
    return df.schema[B].metadata == WHOLE


def _spacing(rows_per_bucket: int) -> tuple[int, int]:
    """(one row in so many is picked, every so many picked rows are a bound)."""
    one_in = max(1, rows_per_bucket // OVERSAMPLE)
    return one_in, max(1, rows_per_bucket // one_in)


def _picked(df: DataFrame, keys: Sequence[str], order: Sequence[str], one_in: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(one_in)) == 0)


def has_hot_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_bucket: int) -> bool:
    """Whether any key has a bound, that is more than one bucket.  Runs a job that shuffles a row a
    picked key; a global order always counts as hot."""
    if not keys:
        return True
    one_in, every = _spacing(rows_per_bucket)
    picks = _picked(df, keys, order, one_in).groupBy(*keys).agg(F.count("*").alias("_seq_n"))
    return not picks.where(F.col("_seq_n") >= every).isEmpty()


def range_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``_seq_b``: a bucket id that never decreases along ``order`` inside a key.

    Small keys have no bound and stay whole; a hot key is cut into about
    ``count / rows_per_bucket`` buckets of even size.  The picked rows of a key (one in
    ``rows_per_bucket / OVERSAMPLE``) are sorted in one array.  A table that is small by estimate
    or has no hot key is not cut, unless a bucket size is asked for."""
    keys, order = _names(keys), _names(order)
    conf = df.sparkSession.conf.get(ROWS_PER_BUCKET_CONF, None)
    if rows_per_bucket is None and conf is None and (
            is_small(df) or not has_hot_key(df, keys, order, DEFAULT_ROWS_PER_BUCKET)):
        return one_bucket(df)
    one_in, every = _spacing(int(rows_per_bucket or conf or DEFAULT_ROWS_PER_BUCKET))
    place = F.struct(*[F.col(c) for c in order])
    picked = _picked(df, keys, order, one_in).select(*keys, place.alias("_seq_at"))
    bounds = F.filter(F.array_sort(F.collect_list("_seq_at")), lambda x, i: (i + 1) % every == 0)
    if keys:
        j = _null_safe_join(df, picked.groupBy(*keys).agg(bounds.alias("_seq_bounds")), keys)
    else:
        j = df.withColumn("_seq_bounds", picked.agg(bounds.alias("_seq_bounds")).scalar())
    b = F.coalesce(_bounds_upto(F.col("_seq_bounds"), place), F.lit(0)).cast("long")
    return j.withColumn(B, b).drop("_seq_bounds")


def _ensure(df: DataFrame, keys, order, rows_per_bucket=None) -> DataFrame:
    return df if B in df.columns else range_buckets(df, keys, order, rows_per_bucket)


def _w(keys, order):
    return Window.partitionBy(*keys, B).orderBy(*order)


def seq_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
            suffix: str = "_prev", rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``<col><suffix>`` = value of the previous row of the same key."""
    return seq_neighbors(df, keys, order, prev=cols, prev_suffix=suffix, rows_per_bucket=rows_per_bucket)


def seq_lead(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
             suffix: str = "_next", rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``<col><suffix>`` = value of the next row of the same key."""
    return seq_neighbors(df, keys, order, next=cols, next_suffix=suffix, rows_per_bucket=rows_per_bucket)


def _full(keys, order):
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _edge_rows(local: DataFrame, at: Column) -> DataFrame:
    """The rows of ``local`` where ``at`` holds, asked for with all their columns.

    The second condition is always true; it keeps the optimizer from pruning columns below the
    window, so that this branch has the same shuffle as the main one and Spark reuses it."""
    plain = [F.col(f.name) for f in local.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return local.where(at & (F.xxhash64(*plain) >= F.lit(-(1 << 63))))


def seq_neighbors(df: DataFrame, keys: Sequence[str], order: Sequence[str], prev: Sequence[str] = (),
                  next: Sequence[str] = (), prev_suffix: str = "_prev", next_suffix: str = "_next",
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Previous-row and next-row values in one pass.

    One window over (key, bucket) gives the in-bucket lag/lead and, on every
    row, the bucket's first and last values; the first row of each bucket is
    the (tiny) edge table whose lag/lead over buckets fills the edges."""
    keys, order, prev, nxt = _names(keys), _names(order), _names(prev), _names(next)
    df = _ensure(df, keys, order, rows_per_bucket)
    w, full = _w(keys, order), _full(keys, order)
    sel = [F.lag(c).over(w).alias(c + prev_suffix) for c in prev] + \
          [F.lead(c).over(w).alias(c + next_suffix) for c in nxt] + \
          [F.row_number().over(w).alias("_seq_rn")]
    if is_whole(df):
        return df.select("*", *sel[:-1])
    if prev:
        sel.append(F.last(F.struct(*[F.col(c) for c in prev])).over(full).alias("_seq_tail"))
    if nxt:
        sel.append(F.first(F.struct(*[F.col(c) for c in nxt])).over(full).alias("_seq_head"))
        sel.append(F.count(F.lit(1)).over(full).alias("_seq_nb_rows"))
    local = df.select("*", *sel)
    ends = _edge_rows(local, F.col("_seq_rn") == 1).select(*keys, B, *(["_seq_tail"] if prev else []),
                                                           *(["_seq_head"] if nxt else []))
    wb = Window.partitionBy(*keys).orderBy(B)
    carry_cols = ([F.lag("_seq_tail").over(wb).alias("_seq_carry_p")] if prev else []) + \
                 ([F.lead("_seq_head").over(wb).alias("_seq_carry_n")] if nxt else [])
    carry = ends.select(*keys, B, *carry_cols)
    out = _null_safe_join(local.drop(*[c for c in ("_seq_tail", "_seq_head") if c in local.columns]), carry, keys + [B])
    for c in prev:
        out = out.withColumn(c + prev_suffix, F.when(F.col("_seq_rn") == 1, F.col("_seq_carry_p")[c])
                             .otherwise(F.col(c + prev_suffix)))
    for c in nxt:
        out = out.withColumn(c + next_suffix, F.when(F.col("_seq_rn") == F.col("_seq_nb_rows"), F.col("_seq_carry_n")[c])
                             .otherwise(F.col(c + next_suffix)))
    return out.drop(*[c for c in ("_seq_rn", "_seq_nb_rows", "_seq_carry_p", "_seq_carry_n") if c in out.columns])


def seq_cumsum(df: DataFrame, keys: Sequence[str], order: Sequence[str], exprs: dict[str, Column],
               rows_per_bucket: int | None = None) -> DataFrame:
    """Add running sums (inclusive of the current row) of each expression per key."""
    keys, order = _names(keys), _names(order)
    df = _ensure(df, keys, order, rows_per_bucket)
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    full = _full(keys, order)
    if is_whole(df):
        return df.select("*", *[F.sum(e).over(w).alias(n) for n, e in exprs.items()])
    local = df.select("*", *[F.sum(e).over(w).alias(n) for n, e in exprs.items()],
                      *[F.sum(e).over(full).alias("_seq_tot_" + n) for n, e in exprs.items()],
                      F.row_number().over(_w(keys, order)).alias("_seq_rn"))
    tot = _edge_rows(local, F.col("_seq_rn") == 1).select(*keys, B, *["_seq_tot_" + n for n in exprs])
    wb = Window.partitionBy(*keys).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, B, *[F.sum("_seq_tot_" + n).over(wb).alias("_seq_off_" + n) for n in exprs])
    out = _null_safe_join(local.drop("_seq_rn", *["_seq_tot_" + n for n in exprs]), off, keys + [B])
    for n in exprs:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col("_seq_off_" + n), F.lit(0)))
    return out.drop(*["_seq_off_" + n for n in exprs])


def seq_cummin(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, before: str,
               rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``name``, the least ``value`` up to this row of the key, and ``before``, that up to the row before
    (NULL on the first)."""
    keys, order = _names(keys), _names(order)
    df = _ensure(df, keys, order, rows_per_bucket)
    upto = _w(keys, order)
    if is_whole(df):
        return df.select("*", F.min(value).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(name),
                         F.min(value).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    local = df.select("*", F.min(value).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(name),
                      F.min(value).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias(before),
                      F.min(value).over(_full(keys, order)).alias("_seq_least"), F.row_number().over(upto).alias("_seq_rn"))
    least = _edge_rows(local, F.col("_seq_rn") == 1).select(*keys, B, "_seq_least")
    wb = Window.partitionBy(*keys).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    carry = least.select(*keys, B, F.min("_seq_least").over(wb).alias("_seq_carry"))
    out = _null_safe_join(local.drop("_seq_least", "_seq_rn"), carry, keys + [B])
    return (out.withColumn(name, F.least(name, "_seq_carry")).withColumn(before, F.least(before, "_seq_carry"))
            .drop("_seq_carry"))


def seq_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
                   rows_per_bucket: int | None = None) -> DataFrame:
    """1-based row number per key, without a single-task window."""
    return seq_cumsum(df, keys, order, {name: F.lit(1).cast("long")}, rows_per_bucket)


def seq_ffill(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str,
              rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``out`` = last non-NULL ``col`` at or before this row (NULL if none)."""
    keys, order = _names(keys), _names(order)
    df = _ensure(df, keys, order, rows_per_bucket)
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    if is_whole(df):
        return df.withColumn(out, F.last(col, ignorenulls=True).over(w))
    local = df.select("*", F.last(col, ignorenulls=True).over(w).alias(out),
                      F.last(col, ignorenulls=True).over(_full(keys, order)).alias("_seq_btail"),
                      F.row_number().over(_w(keys, order)).alias("_seq_rn"))
    tails = _edge_rows(local, F.col("_seq_rn") == 1).select(*keys, B, "_seq_btail")
    wb = Window.partitionBy(*keys).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, B, F.last("_seq_btail", ignorenulls=True).over(wb).alias("_seq_carry"))
    return (_null_safe_join(local.drop("_seq_btail", "_seq_rn"), carry, keys + [B])
            .withColumn(out, F.coalesce(F.col(out), F.col("_seq_carry"))).drop("_seq_carry"))
