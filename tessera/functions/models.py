"""Models as batch functions: the engine starts at their output columns.

A model is any object with `load()` and `batch(values)`; it is loaded once a worker process. HashModel gives
stable vectors from a value's hash and stands in where no model is at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    def load(self) -> None: ...

    def batch(self, values: list) -> list[list[float]]: ...


class HashModel:
    """Unit vectors from hashes."""

    def __init__(self, size: int = 16) -> None:
        self.size = size

    def load(self) -> None:
        pass

    def batch(self, values: list) -> list[list[float]]:
        out = []
        for v in values:
            raw = np.frombuffer(hashlib.blake2b(repr(v).encode(), digest_size=4 * self.size).digest(), np.uint32).astype(float) - 2.0**31
            out.append((raw / np.linalg.norm(raw)).tolist())
        return out


def encoded(model: Model, column: Column, rows: int = 256) -> Column:
    """The model's vector of each value; null for null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model.load()
        for batch in batches:
            known = batch[batch.notna()]
            made = [v for i in range(0, len(known), rows) for v in model.batch(known.iloc[i : i + rows].tolist())]
            yield pd.Series(made, index=known.index, dtype=object).reindex(batch.index).astype(object).where(batch.notna(), None)

    return run(column)


def label_scores(df: DataFrame, key: str, vector: str, positive: dict[str, list[float]], negative: dict[str, list[float]], sharpness: float = 10.0) -> DataFrame:
    """(key, label, score) of every label by prompts: logistic of sharpness * (v.positive - v.negative); one product a batch."""
    labels = sorted(positive)
    prompts = np.array([positive[name] for name in labels]) - np.array([negative[name] for name in labels])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if len(g):
                scores = 1 / (1 + np.exp(-sharpness * np.stack(g[vector].to_list()).astype(float) @ prompts.T))
                yield pd.DataFrame({key: np.repeat(g[key].to_numpy(), len(labels)), "label": np.tile(labels, len(g)), "score": scores.ravel()})

    return df.select(key, vector).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, label string, score double")


def train_labels(df: DataFrame, vector: str, label: str, least: int = 12):
    """A logistic model of a 0/1 label by the vector, or None below `least` rows or two of either kind; fitted by pyspark.ml."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones")).first()
    if n.n < least or min(n.ones or 0, n.n - (n.ones or 0)) < 2:
        return None
    rows = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=60, regParam=0.01).fit(rows)
