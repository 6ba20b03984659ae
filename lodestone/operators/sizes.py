"""Broadcasts behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether the rows of `df`, counted and measured, fit a broadcast. Only meant for sides that are cheap to compute."""
    width = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.octet_length(F.to_json(F.struct(f.name)))
        else:
            width = width + 8
    seen = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return seen["n"] <= max_rows and seen["b"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcast if it was measured to fit; else leave the join to the planner."""
    return F.broadcast(df) if is_small(df, max_bytes, max_rows) else df
