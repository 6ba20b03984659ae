"""Session settings every job relies on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications that name none; the setting itself is fixed once an application runs.
_PRIVATE: dict[str, str] = {}


def get_session(app: str = "lodestone", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "12g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return apply_settings(builder.getOrCreate())


def apply_settings(spark: SparkSession) -> SparkSession:
    """What results depend on, for sessions made elsewhere too.

    A union that claims its children's partitioning breaks once adaptive execution has coalesced
    only some of them.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a private one only in local mode, where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _PRIVATE:
            _PRIVATE[app] = tempfile.mkdtemp(prefix="spark-")
        configured = _PRIVATE[app]
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared checkpoint folder and read it back: lineage ends in files every executor can see."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run; once per application."""
    mark = f"lodestone.shipped.{spark.sparkContext.applicationId}"
    if spark.conf.get(mark, None) is None:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "lodestone")
        archive = shutil.make_archive(target, "zip", os.path.dirname(root), os.path.basename(root))
        spark.sparkContext.addPyFile(archive)
        spark.conf.set(mark, archive)
