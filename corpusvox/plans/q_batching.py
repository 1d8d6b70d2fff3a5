"""Sharding / batching queries.  Arrival order of ``documents`` = doc_id; length = n_chars.
``lineitem`` ordered by (l_orderkey, l_linenumber) stands in for a large sorted manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusvox.operators import batching as Bt
from corpusvox.plans.registry import T, register

WORLD = 8


def _docs(spark, sf):
    d = T(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("n_chars").alias("length"))
    return Bt.with_position(d, ["utt"])


POS_SQL = "d AS (SELECT doc_id AS utt, n_chars AS length, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)"


@register("rank_slice", f"""WITH {POS_SQL}, n AS (SELECT count(*) // {WORLD} AS per FROM d)
SELECT utt, (pos // per)::INTEGER AS rank FROM d, n WHERE pos // per < {WORLD}""")
def q_rank_slice(spark, sf):
    d = _docs(spark, sf)
    n = d.count()
    return Bt.rank_slice(d, "pos", n, WORLD).select("utt", "rank")


@register("strided_shard", f"""WITH {POS_SQL}
SELECT utt, (pos % {WORLD})::INTEGER AS rank, ((pos // {WORLD}) % 2)::INTEGER AS worker FROM d""")
def q_strided(spark, sf):
    d = _docs(spark, sf)
    return Bt.strided_shard(d, "pos", d.count(), WORLD, num_workers=2).select("utt", "rank", "worker")


@register("epoch_shuffle", """
SELECT doc_id AS utt,
       row_number() OVER (ORDER BY md5(concat_ws(':', '7', '3', doc_id::VARCHAR)), doc_id) - 1 AS pos
FROM documents""")
def q_epoch_shuffle(spark, sf):
    d = T(spark, sf, "documents").select(F.col("doc_id").alias("utt"))
    return Bt.epoch_shuffle(d, "utt", epoch=3, seed=7).select("utt", "pos")


@register("sort_buffers", f"""WITH {POS_SQL}
SELECT utt, pos // 500 AS buffer,
       row_number() OVER (PARTITION BY pos // 500 ORDER BY length, pos) - 1 AS idx FROM d""")
def q_sort_buffers(spark, sf):
    return Bt.buffer_order(_docs(spark, sf), "pos", 500, ["length"]).select("utt", "buffer", "idx")


@register("shuffle_buffers", f"""WITH {POS_SQL}
SELECT utt, pos // 100 AS buffer,
       row_number() OVER (PARTITION BY pos // 100 ORDER BY md5(concat_ws(':', '0', '1', utt::VARCHAR)), pos) - 1 AS idx
FROM d""")
def q_shuffle_buffers(spark, sf):
    return Bt.buffer_order(_docs(spark, sf), "pos", 100, [Bt.hash_key(0, 1, "utt")]).select("utt", "buffer", "idx")


@register("rank_full_batches", f"""WITH {POS_SQL}
SELECT utt, pos // 64 AS batch, ((pos % 64) // 16)::INTEGER AS rank FROM d""")
def q_rank_full(spark, sf):
    return Bt.rank_full_batches(_docs(spark, sf), "pos", 16, 4).select("utt", "batch", "rank")


@register("parquet_shards", """
SELECT l_orderkey, l_linenumber,
       (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 1000 AS shard FROM lineitem""")
def q_shards(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return Bt.shard_ids(Bt.with_position(li, ["l_orderkey", "l_linenumber"]), "pos", 1000) \
        .select("l_orderkey", "l_linenumber", "shard")


@register("aligned_slices", f"""WITH {POS_SQL}, n AS (SELECT greatest(count(*) // 7, 1) AS per FROM d)
SELECT utt, least(pos // per, 6)::INTEGER AS slice FROM d, n""")
def q_slices(spark, sf):
    d = _docs(spark, sf)
    return Bt.aligned_slices(d, "pos", d.count(), 7).select("utt", "slice")


def _batches(spark, sf):
    buf = Bt.buffer_order(_docs(spark, sf), "pos", 500, ["length"])
    return Bt.dynamic_batches(buf, "length", budget=40000)


def greedy_sql(buffer: int, budget: int, most: int) -> str:
    """One row after the other inside each buffer: a batch ends where the next row would pass the budget."""
    over = f"greatest(longest, s.length) * (n + 1) > {budget}"
    return f"""WITH RECURSIVE {POS_SQL},
s AS (SELECT utt, length, pos // {buffer} AS buffer,
             row_number() OVER (PARTITION BY pos // {buffer} ORDER BY length, pos) - 1 AS idx FROM d WHERE length <= {most}),
f AS (SELECT buffer, idx, 0 AS b, length AS longest, 1 AS n FROM s WHERE idx = 0
      UNION ALL
      SELECT s.buffer, s.idx, CASE WHEN {over} THEN b + 1 ELSE b END,
             CASE WHEN {over} THEN s.length ELSE greatest(longest, s.length) END, CASE WHEN {over} THEN 1 ELSE n + 1 END
      FROM f JOIN s ON s.buffer = f.buffer AND s.idx = f.idx + 1),
batched AS (SELECT utt, length, s.buffer, s.idx, dense_rank() OVER (ORDER BY s.buffer, b) - 1 AS batch_id
            FROM s JOIN f USING (buffer, idx))"""


BATCH_SQL = greedy_sql(500, 40000, 1 << 40)


@register("local_batches", greedy_sql(30, 20000, 5000) + " SELECT utt, buffer, idx, batch_id FROM batched")
def q_local_batches(spark, sf):
    """Buffers of 30, documents of more than 5000 characters dropped, 20000 padded characters a batch."""
    x = Bt.local_batches(_docs(spark, sf), "pos", "length", 30, 5000, 20000)
    return x.select("utt", "buffer", "idx", "batch_id")


@register("dynamic_batches", BATCH_SQL + " SELECT utt, buffer, idx, batch_id FROM batched")
def q_dynamic(spark, sf):
    """A greedy fold inside each sort buffer."""
    return _batches(spark, sf).select("utt", "buffer", "idx", "batch_id")


@register("batch_stats", BATCH_SQL + """
SELECT batch_id, count(*) AS n, max(length) AS max_len, sum(length)::BIGINT AS sum_len, count(*) * max(length) AS padded,
       1 - sum(length) / (count(*) * max(length)) AS pad_share FROM batched GROUP BY batch_id""")
def q_batch_stats(spark, sf):
    """A24/B9 over the B4 batches."""
    return Bt.batch_stats(_batches(spark, sf), "length")


@register("nbest", """
SELECT l_orderkey, rank, l_linenumber FROM (
  SELECT l_orderkey, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank
  FROM lineitem) WHERE rank <= 2""")
def q_nbest(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return Bt.top_n(li, ["l_orderkey"], "l_extendedprice", 2, "l_linenumber") \
        .select("l_orderkey", F.col("rank").cast("long").alias("rank"), "l_linenumber")


@register("best_of_n", """
SELECT l_orderkey, l_linenumber AS best FROM (
  SELECT l_orderkey, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY (-l_extendedprice / 1000.0) / pow((5 + l_quantity) / 6, 1.0) DESC, l_linenumber) AS r
  FROM lineitem) WHERE r = 1""")
def q_best_of(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                         (-F.col("l_extendedprice") / 1000.0).alias("logprob"))
    return Bt.best_of(li, ["l_orderkey"], "l_linenumber", "logprob", "l_quantity", length_penalty=1.0) \
        .select("l_orderkey", "best")


@register("collate_batches", BATCH_SQL + """,
t AS (SELECT utt, batch_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n
      FROM batched JOIN documents ON doc_id = utt)
SELECT utt, batch_id, batch_id % 8 AS rank, max(n) OVER (PARTITION BY batch_id)::INTEGER AS padded_len,
       (max(n) OVER (PARTITION BY batch_id) - n)::INTEGER AS n_pad FROM t""")
def q_collate(spark, sf):
    """B7 + B9 + B10 over the B4 batches: rank = batch % 8; each row padded to the
    batch's longest token sequence (pad id -1), with its padding mask count."""
    from pyspark.sql import Window

    from corpusvox.functions.text import word_tokens
    from corpusvox.functions.vectors import pad_mask, pad_to
    b = _batches(spark, sf)
    toks = T(spark, sf, "documents").select(F.col("doc_id").alias("utt"),
                                            F.transform(word_tokens("text"), lambda w: F.length(w).cast("long"))
                                            .alias("ids"))
    x = b.join(toks, "utt").withColumn("n", F.size("ids"))
    # a batch is bounded by the frame budget, so the window over it is too
    x = x.withColumn("max_n", F.max("n").over(Window.partitionBy("batch_id")))
    padded = pad_to(F.col("ids"), F.col("max_n"), -1)
    return x.select("utt", "batch_id", F.pmod("batch_id", F.lit(8)).alias("rank"), F.size(padded).alias("padded_len"),
                    F.size(F.filter(pad_mask(F.col("n"), F.col("max_n")), lambda m: m)).alias("n_pad"))
