"""Vector joins: nothing at build time, written lists, what they read, hot lists."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import vectors as vec
from lodestone.operators import index, knn, lexical, search
from lodestone.plans.retrieval import PROBED, cosine_topk, ivf_topk, probes_of
from lodestone.plans.views import Views, label_vectors

FOLDER = "/root/testdata/sf0.1"


def frame(spark, name, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in rows], f"{name} long, vec array<double>")


def test_no_job_runs_before_the_result_is_asked_for(spark):
    q, v = frame(spark, "query_id", [(1, [1, 0])]), frame(spark, "chunk_id", [(1, [1, 1])])
    spark.sparkContext.setJobGroup("build", "build")
    found = knn.nearest(q, v, 3)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("run", "run")
    assert [tuple(r) for r in found.collect()] == [(1, 1, 0.707107, 1)]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("run")


def test_empty_null_and_zero_sides(spark):
    q = frame(spark, "query_id", [(1, [1, 0]), (2, None), (3, [0, 0])])
    v = frame(spark, "chunk_id", [(1, [1, 1]), (2, None), (3, [0, 0]), (4, [-1, 0])])
    assert sorted((r.query_id, r.chunk_id) for r in knn.nearest(q, v, 9).collect()) == [(1, 1), (1, 4)]
    assert knn.nearest(q.limit(0), v, 9).count() == 0 and knn.nearest(q, v.limit(0), 9).count() == 0


def test_written_lists_prune_and_reach_the_recall(spark):
    t = Views(spark, FOLDER)
    exact = {(r.query_id, r.vec_id) for r in cosine_topk(t).collect()}
    found = ivf_topk(t)
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert len(exact & {(r.query_id, r.vec_id) for r in found.collect()}) >= 0.9 * len(exact)
    side = t.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    lists = t.vector_lists
    homes = knn.nearest(side, lists.centroids, 1, key="list_id").groupBy("list_id").agg(F.count("*").alias("n"))
    probed = knn.nearest(label_vectors(t), lists.centroids, probes_of(lists, PROBED), key="list_id").join(homes, "list_id")
    assert probed.groupBy("query_id").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0] <= side.count() / 3


def test_all_lists_equal_the_exact_join_with_a_hot_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knn, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6)) for i in range(200)] + [(200 + i, [1, 2, 3, 4, 5, 6]) for i in range(200)] + [(900, None), (901, [0] * 6)]
    v, q = frame(spark, "chunk_id", rows), frame(spark, "query_id", rows[::7])
    knn.write_lists(v, str(tmp_path), lists=9)
    lists = knn.read_lists(spark, str(tmp_path))
    want = sorted(map(tuple, knn.nearest(q, v, 7).collect()))
    assert sorted(map(tuple, knn.nearest_lists(q, lists, 7, 9, limit_bytes=300).collect())) == want
    for n, some in ((1, v), (None, v.limit(0))):
        path = str(tmp_path / f"lists{n}")
        knn.write_lists(some, path, lists=n)
        assert knn.nearest_lists(q, knn.read_lists(spark, path), 7, 1).count() == (len(want) if n else 0)


def test_copies_of_texts_and_queries_are_compared_once(spark):
    words = ["red apple", "green apple", "red pear", "pear tree apple", "blue plum"]
    rows = [(f"c{i:03d}", f"d{i % 40}", f"w{i % 3}", "u" if i % 2 else None, words[i * i % 5], None, 10, "text", True) for i in range(200)]
    schema = "chunk_id string, document_id string, workspace_id string, user_id string, content string, caption string, token_count int, chunk_type string, selected boolean"
    ix = index.build(spark.createDataFrame(rows, schema))
    assert ix.dense.count() == len({r[4] for r in rows}) and ix.copies.count() == 200
    asked = [(q, ["red apple", "pear"][q % 2], [None, "w1"][q // 2 % 2], [None, "u"][q // 4 % 2], [None, [], ["d1", "d6"]][q % 3]) for q in range(48)]
    q = spark.createDataFrame(asked, "query_id long, text string, workspace_id string, user_id string, document_ids array<string>")
    for drop in ([], ["document_ids"], ["document_ids", "user_id", "workspace_id"]):
        some = q.drop(*drop)
        one = search.embedded(some, ix)
        assert knn._different(one, [c for c in ("workspace_id", "user_id") if c in some.columns])[1].count() == one.drop("query_id", "vec").distinct().count()
        whole = ix.copies.join(ix.dense.select(F.col("chunk_id").alias("first"), "vec"), "first").drop("first")
        plain = knn._nearest(one, whole, 7, "chunk_id", search.SCOPE, None, 1 << 20)
        got = search.semantic(some, ix, 7)
        assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()) == sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in plain.collect())
        assert got.count() > 100


def test_keyword_search_compares_copies_once(spark):
    words = ["red apple tree", "green apple", "red pear", "pear tree apple red", "blue plum red apple apple"]
    rows = [(f"c{i:03d}", f"d{i % 40}", f"w{i % 3}", "u" if i % 2 else None, words[i * i % 5], ["red", None][i % 2], 10, "text", True) for i in range(120)]
    schema = "chunk_id string, document_id string, workspace_id string, user_id string, content string, caption string, token_count int, chunk_type string, selected boolean"
    chunks = spark.createDataFrame(rows, schema)
    ix = index.build(chunks)
    assert ix.postings.where("terms is not null").count() == len({(r[4], r[5]) for r in rows}) and ix.postings.count() == 120
    asked = [(q, ["red apple", "tree", "fig"][q % 3], [None, "w1"][q // 2 % 2], [None, "u"][q // 4 % 2], [None, [], ["d1", "d6"]][q % 5 % 3]) for q in range(30)]
    q = spark.createDataFrame(asked, "query_id long, text string, workspace_id string, user_id string, document_ids array<string>")
    text, fields = index.searchable_text(), ("document_id", "workspace_id", "user_id")
    posts = lexical.postings(chunks, "chunk_id", text, *fields)
    for some in (q, q.drop("document_ids", "user_id", "workspace_id")):
        hits = lexical.bm25_scores(some, posts, lexical.document_frequency(posts), lexical.corpus_stats(chunks, text), "chunk_id", True, fields)
        want = sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in lexical.top_k(search.in_scope(hits, some), 7).collect())
        got = search.keyword(some, ix, 7)
        assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()) == want and len(want) > 30


CHUNKS = "chunk_id string, document_id string, workspace_id string, user_id string, content string, caption string, token_count int, chunk_type string, selected boolean"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _some_chunks(spark):
    words = ["red apple tree", "green apple", "red pear", "pear tree apple red", "blue plum red apple apple"]
    rows = [(f"c{i:03d}", f"d{i % 40}", f"w{i % 3}", "u" if i % 2 else None, words[i * i % 5], ["red", None][i % 2], 10, "text", True) for i in range(120)]
    return spark.createDataFrame(rows, CHUNKS)


def test_keyword_candidates_are_scored_where_their_terms_lie(spark, tmp_path, monkeypatch):
    """However many candidates there are, no posting goes through a shuffle by chunk and term."""
    index.write(_some_chunks(spark), str(tmp_path))
    ix = index.read(spark, str(tmp_path))
    q = spark.createDataFrame([(1, "red apple"), (2, "tree"), (3, "red apple"), (4, "fig"), (5, "plum apple")], "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect())
    want = rows(search.keyword(q, ix, 7))
    assert {r[0] for r in want} == {1, 2, 3, 5}
    monkeypatch.setattr(lexical, "broadcast_if_small", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.keyword(q, ix, 7)
        assert not re.search(r"hashpartitioning\(chunk_id#\d+, token#\d+", _plan(found))
        assert rows(found) == want
        monkeypatch.setattr(lexical, "is_small", lambda df: False)
        assert rows(search.keyword(q, ix, 7)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_stay_where_they_are_when_parts_are_made(spark, tmp_path):
    chunks = _some_chunks(spark)
    index.write(chunks, str(tmp_path))
    made = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    for measured in (True, False):
        assert index._firsts(chunks, made("copies"), measured).count() == made("dense").count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("dense", "postings"):
            # A merge join would move the texts to the marks.
            assert "SortMergeJoin" not in _plan(index._part(name, chunks, made, vec.lexical_counts, str(tmp_path / name)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in _plan(Views(spark, "/root/testdata/sf0.001").corpus)


def test_merges_search_once(spark, tmp_path):
    """The result of a merge reads what was found and holds no search, so none runs again in each of its branches."""
    index.write(_some_chunks(spark), str(tmp_path))
    ix = index.read(spark, str(tmp_path)).without_images()
    q = spark.createDataFrame([(1, "red apple"), (2, "plum")], "query_id long, text string")
    first = search._plain(search.semantic(q, ix, 3), "SEMANTIC").withColumn("score", F.when(F.col("query_id") == 1, 0.6).otherwise(0.001))
    more = spark.createDataFrame([(1, 0, "green apple"), (2, 0, "red apples and pears grow in rows of green trees here")], "query_id long, n int, text string")
    for merge, label in ((search.hyde_merge, "HYDE"), (lambda *a: search.multi_query_merge(*a, use_multi_granularity=False), "MULTI_QUERY")):
        found = merge(q, first, more, ix, 3)
        assert "MapInArrow" not in _plan(found) and label in {r.strategy_used for r in found.collect()}


def test_any_term_ranks_copies_once(spark, tmp_path):
    chunks = _some_chunks(spark).withColumn("caption", F.lit(None).cast("string"))
    index.write(chunks, str(tmp_path))
    q = spark.createDataFrame([(1, "red apple"), (2, "tree plum"), (3, "red apple"), (4, "fig")], "query_id long, text string")
    found = search.keyword(q, index.read(spark, str(tmp_path)), 50, all_terms=False)
    want = lexical.bm25(q, chunks, "chunk_id", F.col("content"), 50)
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect())
    assert rows(found) == rows(want) and len(rows(want)) == 150
