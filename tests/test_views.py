"""Inputs that lie in few row groups."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from lodestone.plans.views import Views


def _documents(folder, n: int, group: int) -> None:
    folder.mkdir()
    rng = random.Random(7)
    text = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(n)]
    rows = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": text, "lang": ["en"] * n, "source": ["src1"] * n, "n_chars": pa.array([len(t) for t in text], pa.int64())})
    pq.write_table(rows, folder / "documents.parquet", row_group_size=group)


def _rows(df) -> list[int]:
    return df.select("document_id").rdd.glom().map(len).collect()


def test_one_row_group_is_read_by_all_tasks(spark, tmp_path):
    """A split of a file has no rows unless the middle of a row group lies in it."""
    _documents(tmp_path / "one", 2000, 10_000)
    _documents(tmp_path / "many", 2000, 50)
    _documents(tmp_path / "empty", 0, 50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        cores = spark.sparkContext.defaultParallelism
        one, many = Views(spark, str(tmp_path / "one")), Views(spark, str(tmp_path / "many"))
        assert one.table("documents").rdd.getNumPartitions() >= cores
        rows = _rows(one.docs)
        assert sum(rows) == 2000 and max(rows) < 2000 / 2
        assert len({r["document_id"] for r in one.docs.select("document_id").collect()}) == 2000
        assert "Exchange" not in many.docs._jdf.queryExecution().executedPlan().toString()
        assert sum(_rows(many.docs)) == 2000
        assert _rows(Views(spark, str(tmp_path / "empty")).docs) in ([], [0] * cores, [0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
