"""Readers and writers of tabular inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import text as tx

CASE_SCHEMA = (
    "cases array<struct<question:string,relevant_keywords:array<string>,category:string,document:string,page:int,"
    "answer_contains:array<string>,pixels_only:boolean,expected_answer:string,expected_keywords:array<string>>>"
)
CHUNK_SCHEMA = (
    "document_id string, content string, page_number int, chunk_index int, token_count int, granularity string,"
    " chunk_type string, caption string, image_key string"
)


def load_passages(df: DataFrame, order: str, limit: int | None = None, at_least: int = 20) -> DataFrame:
    """Passages of a table, from the first text column it has; very short ones are left out. `limit` takes the first rows only."""
    column = next((c for c in ("passage", "text", "content", "context") if c in df.columns), df.columns[0])
    head = df if limit is None else df.orderBy(order).limit(limit)
    return head.withColumn("passage", F.col(column)).where(F.length(tx.strip(F.col("passage"))) >= at_least)


def parse_stats(parsed: DataFrame) -> DataFrame:
    """Totals over rows (document_id, pages, parse_ms)."""
    total, good = F.count("*"), F.count_if(F.col("pages") > 0)
    seconds = F.sum("parse_ms") / 1000
    return parsed.agg(
        total.alias("total_documents"),
        good.alias("successes"),
        (total - good).alias("failures"),
        F.round(F.when(total > 0, good * 100.0 / total).otherwise(0.0), 1).alias("success_rate"),
        F.sum("pages").cast("bigint").alias("total_pages"),
        F.round(F.when(seconds > 0, F.sum("pages") / seconds).otherwise(0.0), 1).alias("pages_per_sec"),
    )


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions of a JSON file; the list may be called cases or items."""
    items = CASE_SCHEMA.replace("cases ", "items ", 1)
    raw = spark.read.schema(f"{CASE_SCHEMA}, {items}").json(path, multiLine=True)
    rows = raw.select(F.inline(F.coalesce("cases", "items")))
    return rows.withColumn("category", F.coalesce("category", F.lit("general")))


def load_claims(spark: SparkSession, path: str) -> DataFrame:
    """Labelled claims (claim, evidence, label) of a JSON file."""
    raw = spark.read.schema("items array<struct<claim:string,evidence:string,label:string>>").json(path, multiLine=True)
    return raw.select(F.inline("items"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object per chunk and line."""
    chunks.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Chunks written before; blank lines are skipped."""
    return spark.read.schema(schema).json(path).where(F.col("content").isNotNull())


def write_lines(lines: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """Text files whose lines follow `order` across and within files."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.mode("overwrite").text(path)


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a new version of a table next to the old one; readers switch by path."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
