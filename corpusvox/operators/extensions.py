"""Extension surface.

* U1 -- a named registry of operator builders, plus SQL registration of
  column functions so they can be called from ``spark.sql``.
* U2 -- a pipeline is an ordered list of ``DataFrame -> DataFrame`` steps
  applied with ``DataFrame.transform``.
* U3 -- batch inference: a user model factory runs inside ``mapInPandas``,
  loaded once per Python worker, fed ``batch_size`` rows at a time, output
  keyed so order never matters.
* U4 -- custom tokenizers are pandas UDFs returning ``ARRAY<STRING>``.
* U5 -- one row to many (chunks, tokens) is ``explode`` / ``posexplode``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, dict[str, Callable]] = {}


def register_op(table: str, name: str):
    """``@register_op('tokenizer', 'char')`` adds a builder to a named table."""
    def deco(fn):
        REGISTRY.setdefault(table, {})[name] = fn
        return fn
    return deco


def lookup_op(table: str, name: str) -> Callable:
    try:
        return REGISTRY[table][name]
    except KeyError as e:
        raise KeyError(f"no {name!r} in registry table {table!r}") from e


def pipeline(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply steps in order (each wraps the previous result)."""
    for s in steps:
        df = df.transform(s)
    return df


_MODELS: dict[str, object] = {}


def batch_inference(df: DataFrame, model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                    schema: T.StructType | str, batch_size: int = 64) -> DataFrame:
    """``model_factory()`` builds a callable ``pdf -> pdf`` once per Python
    worker; rows stream through it in batches of ``batch_size``."""
    token = uuid.uuid4().hex  # travels with the function; an id() could be used again by a later factory

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _MODELS.get(token)
        if model is None:
            model = _MODELS[token] = model_factory()
        for b in batches:
            for i in range(0, len(b), batch_size):
                yield model(b.iloc[i:i + batch_size])

    return df.mapInPandas(run, schema)


def tokenizer_udf(fn: Callable[[str], list[str]]):
    """U4: wrap a per-text tokenizer as an Arrow-batched pandas UDF."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tok(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else list(fn(x)))
    return tok


def register_sql_functions(spark) -> None:
    """U1 for SQL: the Python-backed column functions callable from ``spark.sql``."""
    from corpusvox.functions.text import compression_ratio
    spark.udf.register("compression_ratio", compression_ratio)
