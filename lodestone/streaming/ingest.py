"""Incremental ingest of uploaded files.

Every micro-batch runs the batch functions and writes its rows under its stream and batch number,
so a batch that runs again replaces what it wrote and no stream touches what another has written.
Readers see the newest version of each document.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import chunking, tenancy
from lodestone.sources import parsing

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_files(files: DataFrame, out: str, number: int, cfg: chunking.ChunkConfig = chunking.DEFAULT, run: str = "batch") -> None:
    """Write the tables chunks, documents and dead of a set of files. A bad file only affects its own row.

    Later tables are computed from the written ones, so every file is chunked once.
    """
    spark = files.sparkSession
    accepted, rejected = parsing.admit_files(files)

    def save(table: DataFrame, name: str) -> DataFrame:
        path = f"{out}/{name}/run={run}/batch={number}"
        table.write.mode("overwrite").parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    chunks = save(chunking.ingest(parsing.text_pages(accepted), cfg, one_page=True), "chunks")
    documents = accepted.select(
        F.col("path").alias("document_id"), F.col("length").alias("file_size"), F.lit("processing").alias("status")
    )
    done = tenancy.finalize_status(documents, chunks.select("document_id")).withColumn("ingested_at", F.current_timestamp())
    documents = save(done, "documents")
    failed = documents.where("status = 'error'").select("document_id", F.col("error_message").alias("error"))
    dead = rejected.select(F.col("path").alias("document_id"), F.col("reason").alias("error")).unionByName(failed)
    save(dead.withColumn("ingested_at", F.current_timestamp()), "dead")


def ingest_stream(
    spark: SparkSession, source: str, out: str, checkpoint: str, cfg: chunking.ChunkConfig = chunking.DEFAULT, files_per_batch: int = 1000
) -> StreamingQuery:
    """Watch a folder and ingest its new files, each once. A stream is known by its checkpoint."""
    run = "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        ingest_files(batch, out, number, cfg, run)

    stream = (
        spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").load(source)
    )
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows of the batch that wrote each document last."""
    last = F.max(F.struct("ingested_at", "run", "batch")).alias("last")
    newest = spark.read.parquet(f"{out}/documents").groupBy("document_id").agg(last).select("document_id", "last.run", "last.batch")
    return spark.read.parquet(f"{out}/{name}").join(newest, ["document_id", "run", "batch"], "left_semi").drop("run", "batch")


def dead_letters(spark: SparkSession, out: str, limit: int | None = None) -> DataFrame:
    """Failures; with a limit, the newest."""
    dead = spark.read.parquet(f"{out}/dead")
    return dead if limit is None else dead.orderBy(F.desc("ingested_at"), "document_id").limit(limit)
