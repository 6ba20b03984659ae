"""Merging ranked lists.

A ranked list is rows (query_id, list, chunk_id, score, rank) with ranks from 1. Lists are
already cut to their top entries, so a query's rows are few and bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.lexical import top_k

RRF_K = 60
VISUAL_WEIGHT = 0.7


def named(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.select("query_id", F.lit(name).alias("list"), "chunk_id", "score", "rank")


def stack(*lists: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), lists)


def rrf(lists: DataFrame, k: int | None = None, weight: Column | None = None) -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (60 + rank)."""
    part = (F.lit(1.0) if weight is None else weight) / (RRF_K + F.col("rank"))
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
    if k is not None:
        return top_k(fused, k)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order))


def visual_weight() -> Column:
    return F.when(F.col("list") == "visual", VISUAL_WEIGHT).otherwise(1.0)


def hybrid(lists: DataFrame, semantic_weight: Column | float, k: int) -> DataFrame:
    """Fusion of semantic, keyword, identifier and visual lists.

    Queries with identifier or visual hits use plain weights; all others share the weight
    between the semantic and the keyword list. `semantic_weight` may be a column.
    """
    w = semantic_weight if isinstance(semantic_weight, Column) else F.lit(semantic_weight)
    extra = F.max(F.col("list").isin("ident", "visual")).over(W.partitionBy("query_id"))
    flagged = lists.withColumn("_extra", extra)
    shared = F.when(F.col("list") == "semantic", w).otherwise(1 - w)
    return rrf(flagged, k, F.when(F.col("_extra"), visual_weight()).otherwise(shared))


def merge_diverse(small: DataFrame, large: DataFrame, sizes: DataFrame, k: int, threshold: int = 500) -> DataFrame:
    """Fuse both granularities at half weight; with room left, add the best of a missing size.

    `sizes` holds (chunk_id, token_count).
    """
    both = stack(named(small, "small"), named(large, "large"))
    fused = rrf(both, k, F.lit(0.5)).join(sizes, "chunk_id")
    seen = fused.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.max(F.col("token_count") < threshold).alias("has_small"),
        F.max(F.col("token_count") >= threshold).alias("has_large"),
    )
    first = both.where("rank = 1").join(seen, "query_id")
    want = ((F.col("list") == "small") & ~F.col("has_small")) | ((F.col("list") == "large") & ~F.col("has_large"))
    added = (
        first.where(want & (F.col("n") < k))
        .join(fused.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        .withColumn("_pos", F.when(F.col("list") == "small", 1).otherwise(2))
        .withColumn("rank", (F.col("n") + F.row_number().over(W.partitionBy("query_id").orderBy("_pos"))).cast("int"))
        .where(F.col("rank") <= k)
    )
    cols = ["query_id", "chunk_id", "score", "rank"]
    return fused.select(*cols).unionByName(added.select(*cols))


def splice(core: DataFrame, visual: DataFrame, k: int, at_most: int = 3, key: str = "chunk_id") -> DataFrame:
    """Let up to three visual hits that are not in the core replace its tail."""
    fresh = visual.join(core.select("query_id", key), ["query_id", key], "left_anti")
    order = W.partitionBy("query_id").orderBy("rank", key)
    fresh = fresh.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= at_most)
    count = fresh.groupBy("query_id").agg(F.count("*").alias("m"))
    kept = core.join(count, "query_id", "left").where(F.col("rank") <= k - F.coalesce("m", F.lit(0)))
    size = kept.groupBy("query_id").agg(F.count("*").alias("size"))
    tail = fresh.join(size, "query_id", "left").select(
        "query_id", key, (F.coalesce("size", F.lit(0)) + F.col("pos")).cast("int").alias("rank"), F.lit("visual").alias("origin")
    )
    return kept.select("query_id", key, "rank", F.lit("core").alias("origin")).unionByName(tail)


def ordered_union(first: DataFrame, second: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Entries of both lists, each once, in order of first appearance."""
    both = first.select("query_id", key, F.lit(0).alias("_l"), "rank").unionByName(
        second.select("query_id", key, F.lit(1).alias("_l"), "rank")
    )
    pos = both.groupBy("query_id", key).agg(F.min(F.struct("_l", "rank")).alias("_p"))
    order = W.partitionBy("query_id").orderBy("_p", key)
    return pos.select("query_id", key, F.row_number().over(order).alias("rank"))
