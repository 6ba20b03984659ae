"""From raw files and web pages to pages of text."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions import text as tx

# What an upload may be.
ALLOWED_TYPES = [
    "application/pdf", "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain", "text/markdown",
]
ALLOWED_EXTENSIONS = [".pdf", ".doc", ".docx", ".txt", ".md"]
MAX_BYTES = 50 * 1024 * 1024

# A parser gets the raw value and returns the texts of its pages in order.
Parser = Callable[[object], list[str]]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def admit_files(files: DataFrame, content_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted files and rejected ones with a reason. Only name and size are looked at."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.when(name.contains("."), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise(""))
    known = ext.isin(ALLOWED_EXTENSIONS)
    if content_type is not None:
        known = known | F.coalesce(F.col(content_type).isin(ALLOWED_TYPES), F.lit(False))
    reason = F.when(~known, "Unsupported file type").when(F.col("length") > MAX_BYTES, "File too large")
    judged = files.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def parser_for(file_type: Column) -> Column:
    low = F.lower(file_type)
    return (
        F.when(low.contains("pdf"), "pdf").when(low.contains("word") | low.contains("docx"), "docx").otherwise("text")
    )


def text_pages(files: DataFrame) -> DataFrame:
    """(document_id, page_number, content): a text file is one page, undecodable bytes vanish, blank files too."""
    valid = F.expr("make_valid_utf8(cast(content as string))")
    text = tx.strip(F.replace(valid, F.lit("�"), F.lit("")))
    return files.select(
        F.col("path").alias("document_id"), F.lit(None).cast("int").alias("page_number"), text.alias("content")
    ).where("content <> ''")


def extract_pages(raw: DataFrame, key: str, value: str, parsers: list[tuple[str, Parser]], failures: bool = False) -> DataFrame:
    """Run a chain of parsers over raw values: (key, page_number, content, parser).

    The first parser that returns any text wins; one that fails hands over to the next. Blank
    pages are left out, page numbers stay. A value no parser can read yields no rows, or with `failures` one
    row that has only the column error: what each parser raised, or that it found no text.
    """
    columns = [key, "page_number", "content", "parser"] + ["error"] * failures
    kind = raw.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, v in zip(frame[key], frame[value]):
                problems = []
                for name, parse in parsers:
                    try:
                        pages = [(i, p.strip()) for i, p in enumerate(parse(v), 1) if p and p.strip()]
                        problems.append(f"{name}: no text")
                    except Exception as e:  # noqa: BLE001 - any failure means: try the next parser
                        pages = []
                        problems.append(f"{name}: {type(e).__name__}: {e}")
                    if pages:
                        rows += [(k, i, p, name, None)[: len(columns)] for i, p in pages]
                        break
                else:
                    if failures:
                        rows.append((k, None, None, None, "; ".join(problems)))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"page_number": "Int32"})

    schema = f"{key} {kind}, page_number int, content string, parser string" + ", error string" * failures
    return raw.select(key, value).mapInPandas(run, schema)
