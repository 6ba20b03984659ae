"""Corpus pipeline: quality, boilerplate lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and is written and read again before the next. All but the last return the
columns of `documents`; a stage that changes a text sets n_chars anew. Filtering stages keep every other row as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontaminate, packing, quality, simhash, site_lines
from lodestone.llm.common import free_name, read_table, store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose factorisation-machine score reaches the threshold stay."""
    score = free_name(docs, "_score")
    scored = quality.scored(docs, read_table(spark, sf_dir, "labels"), name=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go."""
    lines = free_name(docs, "_lines")
    cut = site_lines.drop_lines(docs, name=lines)
    n_chars = F.when(F.col(f"{lines}.dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*(n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hits = free_name(docs, "_hits")
    met = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), name=hits)
    return met.filter(F.col(f"{hits}.n_hit") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: where each lies, its ids (little-endian 32-bit) and their checksum."""
    pieces = packing.pack(docs, packing.default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted classifier and similarity groups have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
