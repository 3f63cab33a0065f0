"""Embedding of texts by a pluggable model, with a content-addressed cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from foliant.operators.chunking import hash_embedding


def embed(texts: DataFrame, text: str, dimension: int, load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """Add ``vector`` and ``dimension``; the model is loaded once a task, and a
    vector of another length fails the job (it is a wrong model)."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else lambda xs: [hash_embedding(x, dimension) for x in xs]
        for s in batches:
            known = s.notna()
            made = model(s[known].tolist()) if known.any() else []
            if any(len(v) != dimension for v in made):
                raise ValueError(f"the model's vectors do not have {dimension} elements")
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[known] = pd.Series(list(made), index=s.index[known], dtype=object)
            yield out

    return texts.withColumn("vector", vectors(text)).withColumn("dimension", F.when(F.col("vector").isNotNull(), F.lit(dimension)))


def embed_missing(texts: DataFrame, text: str, cache: DataFrame, dimension: int, load=None) -> DataFrame:
    """Cache rows ``(sha1, vector)`` for texts that the cache does not have."""
    wanted = texts.where(F.col(text).isNotNull()).select(F.sha1(text).alias("sha1"), F.col(text).alias("text")).dropDuplicates(["sha1"])
    return embed(wanted.join(cache.select("sha1"), "sha1", "left_anti"), "text", dimension, load).select("sha1", "vector")
