from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vec
from lodestone.functions.counts import anchor_runs, figures, term_counts
from lodestone.operators import fusion, index, knn, lexical, search

RANKED = "query_id long, list string, chunk_id string, score double, rank int"


def ranked(spark, rows):
    return spark.createDataFrame(rows, RANKED)


def test_rrf_weights_and_ties(spark):
    df = ranked(spark, [(1, "a", "x", 9.0, 1), (1, "a", "y", 8.0, 2), (1, "visual", "y", 1.0, 1), (1, "visual", "z", 0.5, 2)])
    got = {r.chunk_id: r.score for r in fusion.rrf(df, None, fusion.visual_weight()).collect()}
    assert got["y"] == round(1 / 62 + 0.7 / 61, 9) and got["x"] == round(1 / 61, 9)
    tie = ranked(spark, [(1, "a", "b", 1.0, 1), (1, "c", "a", 1.0, 1)])
    assert [r.chunk_id for r in fusion.rrf(tie, 1).collect()] == ["a"]


def test_merge_diverse_adds_the_missing_size(spark):
    small = ranked(spark, [(1, "s", "x", 0.9, 1)])
    large = ranked(spark, [(1, "l", "x", 0.8, 1)])
    sizes = spark.createDataFrame([("x", 100)], "chunk_id string, token_count int")
    assert fusion.merge_diverse(small, large, sizes, 3).count() == 1


def test_splice_replaces_tail(spark):
    core = ranked(spark, [(1, "c", c, 1.0, i) for i, c in enumerate("abcde", 1)])
    vis = ranked(spark, [(1, "v", c, 1.0, i) for i, c in enumerate("bxyzw", 1)])
    got = [r.chunk_id for r in fusion.splice(core, vis, 5).orderBy("rank").collect()]
    assert got == ["a", "b", "x", "y", "z"]


def test_nearest_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(9, 8)), rng.normal(size=(300, 8))
    v[7] = v[8]
    v[9] = 0
    qd = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id long, vec array<double>")
    vd = spark.createDataFrame([(f"{i:03d}", [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id string, vec array<double>")
    for limit in (1 << 20, 150):
        got = {}
        for r in knn.nearest(qd, vd.repartition(5), 6, limit_bytes=limit).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        for i in range(9):
            live = [j for j in range(300) if j != 9]
            s = [round(float(q[i] @ v[j] / np.linalg.norm(q[i]) / np.linalg.norm(v[j])), 6) for j in live]
            want = [f"{j:03d}" for _, j in sorted(zip([-x for x in s], live))[:6]]
            assert got[i] == want


def test_nearest_respects_scope(spark):
    q = spark.createDataFrame(
        [(1, [1.0, 0.0], "a", None), (2, [1.0, 0.0], None, ["d2"])],
        "query_id long, vec array<double>, workspace_id string, document_ids array<string>",
    )
    v = spark.createDataFrame(
        [("x", "d1", "a", [1.0, 0.1]), ("y", "d2", "b", [1.0, 0.5])],
        "chunk_id string, document_id string, workspace_id string, vec array<double>",
    )
    got = {(r.query_id, r.chunk_id) for r in knn.nearest(q, v, 5, scope=("workspace_id",)).collect()}
    assert got == {(1, "x"), (2, "y")}


def test_ivf_recall(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vec")
    )
    q = t.select(F.col("chunk_id").cast("long").alias("query_id"), "vec")
    centroids = knn.train_lists(t, lists=16)
    approx = knn.nearest_ivf(q, knn.assign_lists(t, centroids), centroids, 5, probes=6)
    exact = knn.nearest(q, t, 5)
    hit = exact.join(approx, ["query_id", "chunk_id"], "left_semi").count()
    # Six of sixteen lists hold 37 % of the data; the lists must do far better than chance.
    assert hit / exact.count() > 0.6
    full = knn.nearest_ivf(q, knn.assign_lists(t, centroids), centroids, 5, probes=16)
    assert exact.join(full, ["query_id", "chunk_id"], "left_semi").count() == exact.count()



def test_recall_of_registered_ivf_query(spark):
    import __spark_entry__ as entry

    exact, approx = (entry.queries()[n](spark, "/root/testdata/sf0.01") for n in ("cosine_topk", "ivf_topk"))
    hit = exact.join(approx, ["query_id", "vec_id"], "left_semi").count()
    assert hit / exact.count() >= 0.9


def small_index(spark):
    rows = [
        ("c1", "d1", "w1", None, "apples grow on trees in autumn", None, 10, "text", True),
        ("c2", "d2", "w2", "u1", "pears grow on trees too", None, 600, "text", True),
        ("c3", "d3", "w1", None, "part sku-a10 at Site 12", "FIG-7 pump", 10, "figure", True),
    ]
    schema = "chunk_id string, document_id string, workspace_id string, user_id string, content string, caption string, token_count int, chunk_type string, selected boolean"
    return index.build(spark.createDataFrame(rows, schema))


def test_keyword_needs_all_terms(spark):
    ix = small_index(spark)
    q = spark.createDataFrame([(1, "trees grow"), (2, "trees fly"), (3, "pears TREES")], "query_id long, text string")
    got = sorted((r.query_id, r.chunk_id) for r in search.keyword(q, ix, 5).collect())
    assert got == [(1, "c1"), (1, "c2"), (3, "c2")]


def test_identifiers_match_as_substrings(spark):
    ix = small_index(spark)
    q = spark.createDataFrame([(1, "is SKU-A1 there"), (2, "site 12"), (3, "fig-7?"), (4, "SKU-B"), (5, "site 123")], "query_id long, text string")
    got = sorted((r.query_id, r.chunk_id) for r in search.ident(q, ix, 5).collect())
    assert got == [(1, "c3"), (2, "c3"), (3, "c3")]


def test_shared_identifiers_are_looked_up_once_for_all_queries(spark):
    chunks = [(f"c{i:04d}", f"d{i % 5}", f"w{i % 3}", "u" if i % 2 else None, f"part sku-{i % 9}-{i} at Site {i % 4}1", None) for i in range(600)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, document_id string, workspace_id string, user_id string, content string, caption string")
    places = lexical.anchors(chunks, "document_id", "workspace_id", "user_id")
    asked = [(q, f"site {q % 4} or SKU-{q % 9}-{q}", [None, "w1"][q % 2], [None, None, "u"][q % 3], [None, [], ["d1", "d2", "d1"]][q % 7 % 3]) for q in range(200)]
    scoped = spark.createDataFrame(asked, "query_id long, text string, workspace_id string, user_id string, document_ids array<string>")
    scope = ("workspace_id", "user_id", "document_ids")
    hits = lexical.top_k(search.in_scope(lexical.identifier_hits(scoped, places, ("document_id", "workspace_id", "user_id")), scoped), 5)
    want = sorted((r.query_id, r.chunk_id, r["rank"]) for r in hits.collect())
    assert want == sorted((r.query_id, r.chunk_id, r["rank"]) for r in lexical.identifier_top(scoped, places, 5, scope).collect())
    same = spark.range(200_000).select(F.col("id").alias("query_id"), F.lit("site 1").alias("text"))
    many = spark.range(200_000).select(F.format_string("c%06d", "id").alias("chunk_id"), F.lit("site 12").alias("run"))
    found = lexical.identifier_top(same, many, 2)  # 4e10 pairs of queries and chunks
    assert found.groupBy("chunk_id").count().sort("chunk_id").collect() == [("c000000", 200_000), ("c000001", 200_000)]


def test_token_counts_and_chunk_figures_agree_with_column_functions(spark):
    texts = ["", "Site 12 fig-7 FIG-77x", "a-B a_b Ünï 12½ ²x \u212a9 \u0130stanbul", "x\u00a0y\x1cz\u2003z Z", "one " * 3000, "\u0661\u0662 \u4e00a a\u0301", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(1)
    made = df.select("id", "t", term_counts(F.col("t")).alias("c"), tx.tokens(F.col("t")).alias("tokens")).collect()
    for r in made:
        assert r.c.dl == len(r.tokens) and sorted((x.token, x.tf) for x in r.c.terms) == sorted(Counter(r.tokens).items())
    whole = df.where("t is not null").select("t", F.explode(figures(F.array("t", F.lit("b c")))).alias("f"), tx.alnum_ratio(F.col("t")).alias("a"), tx.unique_ratio(F.col("t")).alias("u")).collect()
    for r in whole[::2]:
        assert (round(r.f.alnum, 9), round(r.f.unique, 9)) == (round(r.a, 9), round(r.u, 9)), r
    start = F.lit(r"(?=((?:sku-|fig-)[a-z0-9-]+|site\s+[0-9]+))")
    runs = df.where("t is not null").select(anchor_runs(F.col("t")).alias("x"), F.regexp_extract_all(F.lower("t"), start, F.lit(1)).alias("y")).collect()
    assert all(r.x == r.y for r in runs)


def test_index_parts_are_written_when_asked_for(spark, tmp_path):
    made = []

    def once(name, write):
        if name not in made:
            write(str(tmp_path))
            made.append(name)
        return str(tmp_path)

    chunks = small_index(spark).chunks
    ix = index.Stored(spark, lambda: chunks.withColumn("content_hash", F.lit("h")), once)
    assert ix.without_images().chunks.count() == 3 and made == ["chunks"]
    q = spark.createDataFrame([(1, "trees grow")], "query_id long, text string")
    assert sorted(r.chunk_id for r in search.keyword(q, ix, 5).collect()) == ["c1", "c2"]
    assert set(made) == {"chunks", "postings", "terms", "stats"}


def test_dispatch_falls_back_and_keeps_the_scope(spark):
    ix = small_index(spark)
    q = spark.createDataFrame(
        [(1, "trees fly", "KEYWORD", None), (2, "apples", "SEMANTIC", ["nowhere"]), (3, "grow", "HYBRID", ["d2"])],
        "query_id long, text string, strategy string, document_ids array<string>",
    )
    got = search.search(q, ix.without_images(), 3, use_multi_granularity=False).collect()
    assert {r.strategy_used for r in got if r.query_id == 1} == {"SEMANTIC"}
    assert not [r for r in got if r.query_id == 2]
    assert {r.chunk_id for r in got if r.query_id == 3} == {"c2"}


def test_merges_keep_the_scope_of_their_query(spark):
    ix = small_index(spark).without_images()
    asked = spark.createDataFrame([(1, "grow", "d2")], "query_id long, text string, d string")
    asked = asked.select("query_id", "text", F.array("d").alias("document_ids"))
    derived = spark.createDataFrame([(1, n, "apples and pears and trees grow here in rows") for n in (0, 1)], "query_id long, n int, text string")
    ranked = spark.createDataFrame([(1, "c2", 0.001, 1, "SEMANTIC")], "query_id long, chunk_id string, score double, rank int, strategy_used string")
    low = ranked.withColumn("score", F.lit(0.6))
    for found in (
        search.hyde_merge(asked, ranked, derived, ix, 5), search.multi_query_merge(asked, low, derived, ix, 5),
        search.multi_query_merge(asked, low, derived, ix, 5, use_multi_granularity=False),
    ):
        rows = found.collect()
        assert {r.chunk_id for r in rows} == {"c2"} and {r.strategy_used for r in rows} <= {"HYDE", "MULTI_QUERY"}
    free = search.multi_query_merge(asked.drop("document_ids"), low, derived, ix, 5).collect()
    assert len({r.chunk_id for r in free}) > 1


def test_confidence_cuts(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (0.69,), (0.7,), (None,)], "s double")
    assert [r.c for r in df.select(search.confidence(F.col("s")).alias("c")).collect()] == ["very_low", "low", "low", "high", "very_low"]


def test_rerank_constant_scores(spark):
    rows = [(1, "q", f"c{i}", "text", None, 0.5, i) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "query_id long, text string, chunk_id string, content string, caption string, score double, rank int")
    assert {r.score for r in search.rerank(df, 2).collect()} == {0.5}


def test_lexical_vector(spark):
    df = spark.createDataFrame([("red apple",), ("Apple, red",), ("",)], "t string")
    a, b, c = [np.array(r.v) for r in df.select(vec.lexical_vector(F.col("t"), 64).alias("v")).collect()]
    assert np.allclose(a, b) and abs(c @ c - 1) < 1e-9


def test_parse_vector(spark):
    import pytest

    ok = spark.createDataFrame([("[1, 2.5]",), (None,)], "t string").select(vec.parse_vector(F.col("t")).alias("v")).collect()
    assert ok[0].v == [1.0, 2.5] and ok[1].v is None
    with pytest.raises(Exception, match="Invalid embedding"):
        spark.createDataFrame([("oops",)], "t string").select(vec.parse_vector(F.col("t"))).collect()


def test_bm25_matches_formula(spark):
    import math

    docs = spark.createDataFrame([("a", "x y y"), ("b", "y z"), ("c", "")], "id string, t string")
    q = spark.createDataFrame([(1, "y y z")], "query_id long, text string")
    got = {r.id: r.score for r in lexical.bm25(q, docs, "id", F.col("t"), 5).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda f, dl, df: idf(df) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / (5 / 3)))
    assert got == {"a": round(2 * part(2, 3, 2), 6), "b": round(2 * part(1, 2, 2) + part(1, 2, 1), 6)}


def test_derived_queries_of_ids_with_a_number_sign_stay_apart(spark):
    ix = small_index(spark)
    q = spark.createDataFrame([("a", "no match here", None), ("a#1", "nothing at all", "w2")], "query_id string, text string, workspace_id string")
    ranked = spark.createDataFrame([("a", "c9", 0.01, 1, "HYBRID"), ("a#1", "c9", 0.01, 1, "HYBRID")], "query_id string, chunk_id string, score double, rank int, strategy_used string")
    text = "pears grow on trees too and apples grow on trees in autumn, " * 3
    made = spark.createDataFrame([("a", 1, text), ("a#1", 1, text)], "query_id string, n int, text string")
    got = {(r.query_id, r.chunk_id) for r in search.hyde_merge(q, ranked, made, ix, 5).collect() if r.strategy_used == "HYDE"}
    assert {c for i, c in got if i == "a#1"} == {"c2", "c9"} and {"c1", "c2"} <= {c for i, c in got if i == "a"}
