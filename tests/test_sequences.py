import random

from pyspark.sql import functions as F

from lodestone.operators import metrics, sequences


def test_newest_equals_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "cold", None]), rng.choice([1, None]), rng.choice([None, *range(50)]), i) for i in range(12000)]
    rows.append(("one", 1, 3, 12000))
    df = spark.createDataFrame(rows, "k string, j int, ts int, id int").repartition(7)
    for n in (1, 1200, 20000):
        got = {}
        for r in sequences.newest(df, ["k", "j"], ["ts", "id"], n, fan=3).collect():
            got.setdefault((r.k, r.j), []).append(r.id)
        groups = {}
        for k, j, ts, i in rows:
            groups.setdefault((k, j), []).append((-1 if ts is None else ts, i))
        want = {key: sorted(i for _, i in sorted(seen)[-n:]) for key, seen in groups.items()}
        assert {key: sorted(ids) for key, ids in got.items()} == want


def test_newest_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, ts int")
    assert sequences.newest(empty, ["k"], ["ts"], 5).collect() == []


def test_tasks_keep_their_last_rows_before_anything_moves(spark):
    df = spark.range(0, 40000, 1, 8).select(F.lit("hot").alias("k"), F.col("id"))
    last = sequences.newest(df, ["k"], ["id"], 2000)
    plan = last._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")
    assert len(below) == 3 and all("MapInArrow" in part for part in below), plan
    assert "Window" not in plan
    assert last.agg(F.min("id")).first()[0] == 38000


def test_summary_of_the_last_observations(spark):
    rows = [("a", float(i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "path string, latency double, ts int")
    got = metrics.latency_summary(df, "path", "latency", ["ts"], kept=1500).first()
    assert (got["count"], got["min"], got["max"], got["p50"]) == (1500, 1500.0, 2999.0, 2250.0)
