import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from lodestone.operators import admission, cache, tenancy
from lodestone.operators.sequences import carry_last
from lodestone.streaming import ingest, requests as rq


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def text(i):
    return " ".join(f"word{i}n{j}" for j in range(80)) + "."


def test_three_batches_equal_one(spark):
    src = Path(folder())
    for i in range(6):
        (src / f"f{i}.txt").write_text(text(i))
    (src / "blank.txt").write_text("  \n ")
    (src / "bad.exe").write_text("x")
    (src / "raw.md").write_bytes(b"\xff\xfe" + text(99).encode() + b"\xc3")
    tables = []
    for per_batch in (100, 5):
        out = folder()
        ingest.ingest_stream(spark, str(src), out, folder(), files_per_batch=per_batch).awaitTermination()
        chunks = ingest.current(spark, out, "chunks").select("chunk_id", "content", "selected").collect()
        docs = ingest.current(spark, out, "documents").select("document_id", "status", "chunk_count", "error_message").collect()
        dead = {(Path(r.document_id).name, r.error) for r in ingest.dead_letters(spark, out).collect()}
        tables.append((sorted(map(tuple, chunks)), sorted(tuple(map(str, r)) for r in docs)))
        assert dead == {("blank.txt", tenancy.NO_CONTENT), ("bad.exe", "Unsupported file type")}
    assert tables[0] == tables[1] and len(tables[0][0]) == 7
    assert not any("�" in c[1] for c in tables[0][0])


def test_a_second_stream_leaves_the_first_alone(spark):
    out, sources = folder(), [Path(folder()), Path(folder())]
    for i, src in enumerate(sources):
        (src / f"f{i}.txt").write_text(text(i))
        ingest.ingest_stream(spark, str(src), out, folder()).awaitTermination()
    docs = ingest.current(spark, out, "documents").collect()
    assert sorted(Path(r.document_id).name for r in docs) == ["f0.txt", "f1.txt"]
    assert ingest.current(spark, out, "chunks").select("document_id").distinct().count() == 2


def log(spark, stamps):
    rows = [(c, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)) for c, s in stamps]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["client", "ts"]))


def brute(stamps, per_minute, per_hour):
    out, logs = {}, {}
    for client, s in sorted(stamps, key=lambda x: x[1]):
        minute, hour = logs.setdefault(client, ([], []))
        ok = len([t for t in minute if t > s - 60]) < per_minute
        if ok:
            minute.append(s)
            ok = len([t for t in hour if t > s - 3600]) < per_hour
            if ok:
                hour.append(s)
        n, a = out.get((client, s), (0, 0))
        out[(client, s)] = (n + 1, a + ok)
    return out


def test_admission_batch_and_stream(spark):
    import random

    rng = random.Random(2)
    stamps = [("a", rng.randrange(0, 20000)) for _ in range(150)] + [("a", 9000 + i % 40) for i in range(60)]
    stamps += [("b", i * 5000) for i in range(10)]
    want = brute(stamps, 5, 20)
    epoch = int(pd.Timestamp("2024-01-01").timestamp())
    decided = admission.admit(log(spark, stamps), 5, 20)
    got = {(r.client, r.second - epoch): (r.requests, r.admitted) for r in decided.collect()}
    assert got == want
    labelled = admission.label_requests(log(spark, stamps).withColumn("id", F.monotonically_increasing_id()), decided, "id")
    assert labelled.where("admitted").count() == sum(a for _, a in want.values())
    src = folder()
    log(spark, stamps).orderBy("ts").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("client string, ts timestamp").parquet(src)
    # A processing-time timeout keeps asking for further batches, so only a bounded trigger ends.
    sink = rq.admit(stream, 5, 20).writeStream.format("memory").queryName("gate").outputMode("append")
    sink.trigger(once=True).start().awaitTermination(120)
    streamed = {(r.client, r.second - epoch): (r.requests, r.admitted) for r in spark.table("gate").collect()}
    assert streamed == want


def test_quiet_clients_skip_the_walk(spark):
    decided = admission.admit(log(spark, [("a", i * 100) for i in range(30)]), 60, 1000).collect()
    assert all(r.admitted == r.requests for r in decided)


def test_replay_anchors_on_the_last_miss(spark):
    hours = [0, 20, 23, 25, 40, 48, 50, 80]
    rows = [("n", "how", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)) for h in hours]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ns", "query", "ts"]))
    missed = [r.second for r in cache.replay(df).where("misses = 1").orderBy("second").collect()]
    start = int(pd.Timestamp("2024-01-01").timestamp())
    assert [(s - start) // 3600 for s in missed] == [0, 25, 50, 80]


def test_carry_last_over_segments(spark):
    import random

    rng = random.Random(1)
    rows = [("k", i, rng.random() < 0.2, f"v{i}") for i in range(200)] + [("m", 7, False, "x"), ("m", 90, True, "y")]
    df = spark.createDataFrame(rows, "k string, i long, u boolean, v string")
    for segment in (4, 1000):
        got = {(r.k, r.i): r.o for r in carry_last(df, "k", "i", F.col("u"), "v", "o", segment).collect()}
        last = None
        for k, i, u, v in rows[:200]:
            assert got[(k, i)] == last
            last = v if u else last
        assert got[("m", 7)] is None and got[("m", 90)] is None


def test_stuck_documents_and_first_asked(spark):
    src = folder()
    at = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    first = [("a", "processing", at(0)), ("b", "processing", at(0)), ("b", "ready", at(2))]
    second = [("c", "ready", at(30))]
    for rows in (first, second, [("d", "ready", at(31))]):
        pdf = pd.DataFrame(rows, columns=["document_id", "status", "ts"])
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("document_id string, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = rq.stuck_documents(stream).writeStream.format("memory").queryName("stuck").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.document_id, r.status, r.error_message) for r in spark.table("stuck").collect()] == [("a", "error", tenancy.STUCK)]
    src = folder()
    asked = pd.DataFrame([("n", "Hi", at(0)), ("n", " hi ", at(1)), ("m", "hi", at(2)), ("n", "latest news", at(0)), ("n", "latest news", at(30)), ("n", "latest news", at(90)), ("n", "hi", at(95))], columns=["ns", "query", "ts"])
    spark.createDataFrame(asked).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ns string, query string, ts timestamp").parquet(src)
    q = rq.first_asked(stream).writeStream.format("memory").queryName("asked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.ns for r in spark.table("asked").where("query <> 'latest news'").collect()) == ["m", "n"]
    assert spark.table("asked").where("query = 'latest news'").count() == 2  # one hour, not a day


def test_request_metrics_stream(spark):
    src = folder()
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=20 * i), "p", 200, float(i)) for i in range(12)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "path", "status", "latency"])).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, path string, status long, latency double").parquet(src)
    q = rq.request_metrics(stream).writeStream.format("memory").queryName("rm").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.requests for r in spark.table("rm").orderBy("w").collect()] == [3, 3, 3]
