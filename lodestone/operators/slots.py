"""Model slots: swappable functions for embedding, scoring, labelling and generation.

A slot is any function from columns to a column (a built-in expression or a pandas UDF).
The defaults are deterministic and need no model files.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

EmbedSlot = Callable[[Column], Column]


def embed_once(df: DataFrame, text: str, key: str, embed: EmbedSlot, known: DataFrame | None = None) -> DataFrame:
    """Add `vec`, embedding every distinct text once.

    `known` holds (key, vec) of texts embedded before; they are reused. Only keys without a
    vector reach the model, so repeated texts cost one call however often they occur.
    """
    todo = df.select(key, text).groupBy(key).agg(F.first(text).alias(text))
    if known is not None:
        known = known.where(F.col("vec").isNotNull()).groupBy(key).agg(F.first("vec").alias("vec"))
        todo = todo.join(known.select(key), key, "left_anti")
    fresh = todo.select(key, embed(F.col(text)).alias("vec"))
    return df.join(fresh if known is None else fresh.unionByName(known.select(key, "vec")), key, "left")


def guarded(embed: EmbedSlot, dim: int) -> EmbedSlot:
    """A slot whose missing results become zero vectors, which never match."""

    def safe(text: Column) -> Column:
        return F.coalesce(embed(text), F.array_repeat(F.lit(0.0), dim).cast("array<float>"))

    return safe


def embed_visual(df: DataFrame, image: str, caption: str, text: str, embed_text: EmbedSlot, embed_image=None) -> DataFrame:
    """Add `clip_vec` to rows with an image: from the image where it can be read, else from its words."""
    words = F.coalesce(F.nullif(F.col(caption), F.lit("")), F.col(text), F.lit(""))
    vector = embed_text(F.concat_ws(" ", F.nullif(F.col(caption), F.lit("")), F.nullif(F.col(text), F.lit(""))))
    vector = embed_text(words) if embed_image is None else F.coalesce(embed_image(F.col(image)), vector)
    return df.withColumn("clip_vec", F.when(F.col(image).isNotNull(), vector))


def generate(df: DataFrame, prompt: str, out: str, model: Callable[[Column], Column]) -> DataFrame:
    """Add the text a generator slot returns; used for hypothetical answers and query variations."""
    return df.withColumn(out, model(F.col(prompt)))


def reuse_plan(chunks: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """Add `reused`: whether a text with this hash has a vector already, in any document."""
    known = embedded.select(key).distinct().withColumn("_known", F.lit(True))
    return chunks.join(known, key, "left").select(*chunks.columns, F.coalesce("_known", F.lit(False)).alias("reused"))
