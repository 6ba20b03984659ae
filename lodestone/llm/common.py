"""Helpers the operators share: stored intermediate tables, Python stages, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.session import ship_package, store as store

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_ROWS = "1000"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete a table that `store` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone/" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: whatever they were called, no name can clash with an operator's own."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with this package importable in the workers and batches that are small for long texts too."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what a task holds at once is bounded."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all other characters unchanged. Where no other character has a lower form, `lower` does the same faster."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(c))


def crc_remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo `n`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


class WordCodes(dict):
    """Word -> consecutive number, grown on demand; looked up at C speed through `map(codes.__getitem__, words)`."""

    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def code_array(codes: dict, words: list) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of `counts`, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
