"""Exact join of sparse vectors by a least cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import vectors as vec

#: Scores are rounded to six digits before they are compared.
SLACK = 1e-6


def rare_first(vectors: DataFrame) -> Column:
    """Places of a vector, those first that the fewest vectors use; one small row, as there are no more than dimensions."""
    used = vectors.select(F.posexplode("vec").alias("i", "w")).where("w <> 0").groupBy("i").agg(F.count("*").alias("n"))
    size = vectors.agg(F.max(F.size("vec")).alias("d"))
    every = size.select(F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("i")).where("i >= 0")
    ordered = every.join(used, "i", "left").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i"))).alias("o"))
    return ordered.select(F.transform("o", lambda s: s["i"])).scalar()


def prefixes(vectors: DataFrame, key: str, order: Column, threshold: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry.., place, left): the places in `order` from which on a unit vector still has a norm of `threshold`, and that norm.

    Two vectors share no weight before the first place that both use, so their cosine is at most the product of the
    norms that are left there; if it reaches the threshold, that place is among the prefixes of both.
    """
    kept = [key, *carry]
    side = vectors.select(*kept, "vec", order.alias("_order")).select(*kept, F.transform("_order", lambda i: F.get("vec", i).cast("double")).alias("w"))
    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in kept) + ", place int, left double"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) ** 2
            total = w.sum(axis=1, keepdims=True)
            rest = np.cumsum(w[:, ::-1], axis=1)[:, ::-1] / np.where(total > 0, total, 1)
            row, place = np.nonzero((w > 0) & (rest >= max(0.0, threshold - SLACK) ** 2))
            columns = [batch.column(c).take(pa.array(row)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place.astype(np.int32)), pa.array(np.sqrt(rest[row, place]))], names=[*kept, "place", "left"])

    return side.mapInArrow(run, schema)


def join(left: DataFrame, right: DataFrame, threshold: float, left_key: str, right_key: str, same: tuple[str, ...] = ()) -> DataFrame:
    """(left_key, right_key, score): all pairs of at least that cosine whose `same` columns are equal (nulls too).

    An inverted index over the prefixes of both sides meets by place and `same`; pairs whose remaining norms cannot
    reach the threshold go at once, the others are compared in full, once each. Null and zero vectors never match.
    All vectors have one length; `left_key` and `right_key` are unique and differ in name.
    """
    order = rare_first(right.where(F.col("vec").isNotNull()))
    a = prefixes(left.where(F.col("vec").isNotNull()), left_key, order, threshold, same)
    b = prefixes(right.where(F.col("vec").isNotNull()), right_key, order, threshold, same)
    b = b.select(right_key, F.col("place").alias("_place"), F.col("left").alias("_left"), *(F.col(c).alias(f"_{c}") for c in same))
    test = (F.col("place") == F.col("_place")) & (F.col("left") * F.col("_left") >= threshold - SLACK)
    for c in same:
        test = test & F.col(c).eqNullSafe(F.col(f"_{c}"))
    pairs = a.join(b, test).select(left_key, right_key).distinct()
    full = pairs.join(left.select(left_key, F.col("vec").alias("_a")), left_key).join(right.select(right_key, F.col("vec").alias("_b")), right_key)
    return full.select(left_key, right_key, F.round(vec.cosine(F.col("_a"), F.col("_b")), 6).alias("score")).where(F.col("score") >= threshold)
