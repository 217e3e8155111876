"""Vector functions over array<float|double> columns."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x
    )


def l2_score(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    return 1 / (1 + squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    """0.0 for missing, empty or zero vectors and for different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norms > 0)
    return F.coalesce(F.when(usable, dot(a, b) / norms), F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


class Embedder(Protocol):
    """Texts to vectors of one length; a model outside of this package."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def embed(text: Column, embedder: Embedder, dimension: int, batch: int = 16) -> Column:
    """Vectors of a text column, in batches; a vector of another length is an error. Null and blank texts have none."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(values: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        wanted = [k for k, v in enumerate(values) if v is not None and v.strip()]
        for at in range(0, len(wanted), batch):
            some = wanted[at : at + batch]
            vectors = embedder([values.iloc[k] for k in some])
            if len(vectors) != len(some) or any(len(v) != dimension for v in vectors):
                raise ValueError(f"embedder must give {len(some)} vectors of {dimension} numbers")
            for k, v in zip(some, vectors):
                out[k] = [float(x) for x in v]
        return pd.Series(out)

    return run(text)
