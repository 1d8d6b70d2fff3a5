"""Property checks: sequence helpers equal a sorted pandas computation for any
bucket size; batching partitions its input."""
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusvox.plans.sequence import range_buckets, seq_cumsum, seq_ffill, seq_neighbors

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "hot", "hot", "hot"]), st.integers(0, 50),
                          st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=rows, rpb=st.integers(1, 20))
def test_sequence_helpers_any_bucket_size(spark, data, rpb):
    tagged = [(k, t, i, v) for i, (k, t, v) in enumerate(data)]
    df = spark.createDataFrame(tagged, "key string, t long, id long, v int")
    x = range_buckets(df, ["key"], ["t", "id"], rows_per_bucket=rpb)
    x = seq_neighbors(x, ["key"], ["t", "id"], prev=["id"], next=["id"])
    x = seq_cumsum(x, ["key"], ["t", "id"], {"cs": F.col("t")})
    x = seq_ffill(x, ["key"], ["t", "id"], "v", "ff")
    got = x.toPandas().set_index("id").sort_index()
    pdf = pd.DataFrame(tagged, columns=["key", "t", "id", "v"]).sort_values(["key", "t", "id"])
    g = pdf.groupby("key")
    exp = pdf.assign(id_prev=g["id"].shift(1), id_next=g["id"].shift(-1), cs=g["t"].cumsum(),
                     ff=g["v"].ffill()).set_index("id").sort_index()
    for c in ["id_prev", "id_next", "cs", "ff"]:
        a, b = got[c].astype("float"), exp[c].astype("float")
        assert ((a == b) | (a.isna() & b.isna())).all(), c
