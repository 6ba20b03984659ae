"""Vector columns: hashing vectors and cosine arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from lodestone.functions.counts import hashed_rows, hashed_vector

DENSE_DIM = 512


def lexical_counts(text: Column, dim: int = DENSE_DIM) -> Column:
    """Unnormalised hashing vector. Cosine does not see the scale and float32 stays exact."""
    return hashed_vector(text, dim)


def lexical_vector(text: Column, dim: int = DENSE_DIM) -> Column:
    """Hashing vector of unit length; texts with shared tokens lie close together."""

    @pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        found = hashed_rows(list(texts), dim).astype(np.float64)
        return pd.Series(list(found / np.maximum(np.sqrt((found * found).sum(axis=1)), 1e-300)[:, None]))

    return embed(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def parse_vector(c: Column, dim: int | None = None) -> Column:
    """Vector from its JSON text; raises on anything that is not a list of numbers."""
    parsed = F.from_json(c, "array<double>")
    bad = parsed.isNull() | F.exists(parsed, lambda x: x.isNull())
    if dim is not None:
        bad = bad | (F.size(parsed) != dim)
    return F.when(c.isNull(), F.lit(None).cast("array<double>")).when(
        bad, F.raise_error(F.concat(F.lit("Invalid embedding value: "), c)).cast("array<double>")
    ).otherwise(parsed)
