"""Order-dependent work that must not hang on one key.

A key may hold a large share of all rows, so its sequence is cut into segments. Segments are
worked on in parallel and what one hands to the next is a small table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def carry_last(df: DataFrame, key: str, order: str, when: Column, value: str, out: str, segment: int = 4096) -> DataFrame:
    """Add the `value` of the last earlier row of the key for which `when` holds.

    `order` is a whole number, distinct within a key. Inside a segment of its range a window
    finds the row; the last one of all earlier segments fills the rest.
    """
    part = F.floor(F.col(order) / segment)
    rows = df.withColumn("_seg", part).withColumn("_v", F.when(when, F.struct(F.col(value).alias("x"))))
    inside = W.partitionBy(key, "_seg").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    ends = (
        df.where(when)
        .groupBy(key, part.alias("_seg"))
        .agg(F.max_by(F.struct(F.col(value).alias("x")), order).alias("_end"))
    )
    every = df.select(key, part.alias("_seg")).distinct().join(ends, [key, "_seg"], "left")
    before = W.partitionBy(key).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    starts = every.select(key, "_seg", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    joined = rows.join(starts, [key, "_seg"], "left")
    return joined.select(*df.columns, F.coalesce("_in", "_before")["x"].alias(out))


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], scan, schema: str) -> DataFrame:
    """Run `scan` over rows sorted within their keys.

    `scan(iterator of pandas frames)` sees whole partitions as a stream and keeps only the
    state of the current key, so no group is ever held in memory.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)


def newest(df: DataFrame, keys: list[str], order: list[str], n: int, fan: int = 64) -> DataFrame:
    """The `n` last rows of every key by `order`, nulls first; `order` is distinct within a key, else ties are open.

    A bounded aggregate in three rounds: each task keeps `n` rows of a key, then the tasks' rows meet in `fan` groups
    of a key, then these. So one task reads at most `fan` * `n` rows of a key at the end, and of the whole key
    never more than its own input, whatever `n` is; a ranking window moves whole keys for large `n`.
    """
    marked = df.withColumn("_newest_key", F.to_json(F.struct(*keys)))
    marked = marked.withColumn("_newest_group", F.spark_partition_id() % fan)

    def cut(rows: DataFrame) -> DataFrame:
        ordered = rows.sortWithinPartitions("_newest_key", *[F.desc(c) for c in order])
        return ordered.mapInArrow(_head("_newest_key", n), rows.schema)

    some = cut(cut(marked).repartition("_newest_key", "_newest_group"))
    return cut(some.repartition("_newest_key")).select(*df.columns)


def _head(key: str, n: int):
    """Stream sorted batches, leaving the first `n` rows of every key; the state is one key and a count."""

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(key)
            before = pa.concat_arrays([pa.array([last], names.type), names.slice(0, len(names) - 1)])
            starts = pc.fill_null(pc.not_equal(names, before), True).to_numpy(zero_copy_only=False)
            at = np.arange(len(names))
            place = at - np.maximum.accumulate(np.where(starts, at, -seen))
            last, seen = names[-1].as_py(), int(place[-1]) + 1
            yield batch.filter(pa.array(place < n))

    return run
