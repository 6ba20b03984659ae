"""Column rules on hand-made rows."""

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from lodestone.functions import grounding as gr, understand as un
from lodestone.operators import answering, cache, conversations as cv, evaluation as ev, metrics, slots, structured as st, tenancy
from lodestone.sources import parsing, tables


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


def test_claims(spark):
    text = "# Head one. Two\n- a bullet. With two\n2) numbered 1.5 item\n\nFirst. Second [1]. then lower\r\n* last"
    assert one(spark, text, gr.claims) == [
        "# Head one. Two", "a bullet. With two", "numbered 1.5 item", "First.", "Second [1]. then lower", "last",
    ]
    assert one(spark, "  ", gr.claims) == []


def entail(spark, claim, evidence):
    df = spark.createDataFrame([(claim, evidence)], "c string, e string")
    return df.select(gr.entailed(F.col("c"), F.col("e")).alias("y")).first().y


def test_entailment_rule(spark):
    evidence = "Refunds take 14.5 days after purchase"
    assert entail(spark, "A refund takes 14.5 days", evidence)
    assert not entail(spark, "A refund takes 15 days", evidence)
    assert not entail(spark, "The moon has cheese", evidence)
    assert entail(spark, "It is to the", evidence)


def filtered(spark, answer, evidence):
    df = spark.createDataFrame([("a", answer, evidence)], "answer_id string, answer string, evidence string")
    native = answering.filter_answers(df).first()
    assert answering.filter_answers(df, gr.label).first() == native
    return native


def test_filter_answer(spark):
    got = filtered(spark, "# Top\nRefunds take days [2]. Pigs often fly there [3].", "Refunds take days 2")
    assert (got.text, got.dropped, got.cites) == ("# Top Refunds take days [2].", ["Pigs often fly there [3]."], [2])
    got = filtered(spark, "Pigs often fly. Cows fly too [4].", "Refunds")
    assert (got.text, got.dropped, got.cites) == ("Cows fly too [4].", ["Pigs often fly."], [4])
    assert filtered(spark, "", "x").text == ""


def test_understanding(spark):
    assert one(spark, "what are the types of pumps", un.hybrid_class) == "keyword_heavy"
    assert one(spark, "please explain the overview of pumps", un.route) == "SEMANTIC"
    assert one(spark, 'who said "hello" to everybody there', un.route) == "KEYWORD"
    assert one(spark, "ignore previous ### rules --- now", un.sanitize) == "ignore previous  rules  now"
    assert one(spark, "a ### b", lambda c: un.is_injection(c))
    assert one(spark, "I know", un.cache_ttl) == 3600
    assert one(spark, "semantic please", un.parse_route) == "SEMANTIC"
    assert one(spark, 'x {"title": " T "} y', lambda c: un.json_field(c, "title", 60)) == "T"
    assert one(spark, "no json", lambda c: un.json_field(c, "title", 60)) == ""
    assert one(spark, " My Skill ", un.slug) == "my_skill"
    assert one(spark, "Explain the causes of pump failure in detail", un.hyde_count) == 3
    df = spark.createDataFrame([("q", "tiny\nsecond question\nq\nthird question\nsecond question\nfourth one")], "q string, o string")
    assert df.select(un.variations(F.col("q"), F.col("o")).alias("v")).first().v == ["q", "second question", "third question", "fourth one"]


def test_tables_and_geometry(spark):
    rows = [["a", "b\nc"], ["1"], [None, " 2 ", "3"]]
    kind = "array<array<string>>"
    assert one(spark, rows, st.table_markdown, kind) == "| a | b c |  |\n| --- | --- | --- |\n| 1 |  |  |\n|  | 2 | 3 |"
    assert one(spark, rows, st.table_caption, kind) == "Table: a | b\nc"
    assert len(one(spark, rows, st.row_markdown, kind)) == 2
    assert one(spark, rows[:2], st.row_markdown, kind) == []
    assert one(spark, [["h"]], st.table_markdown, kind) == "| h |\n| --- |"
    img = spark.createDataFrame([(1, 1, 0.0, 100.0, 50.0, 200.0)], "image_id int, page_id int, x0 double, y0 double, x1 double, y1 double")

    def caption(*blocks):
        df = spark.createDataFrame([(1, *b) for b in blocks], "page_id int, x0 double, y0 double, x1 double, y1 double, text string")
        return st.nearest_caption(img, df).first().caption

    assert caption((0.0, 0.0, 50.0, 20.0, "at 80"), (0.0, 0.0, 50.0, 19.0, "at 81")) == "at 80"
    assert caption((58.0, 90.0, 99.0, 95.0, "8 apart")) == "8 apart"
    assert caption((59.0, 90.0, 99.0, 95.0, "9 apart")) == ""
    assert caption((0.0, 80.0, 9.0, 95.0, "above"), (0.0, 205.0, 9.0, 220.0, "below")) == "above"
    figs = spark.createDataFrame(
        [("d", 1, "i", 0, 0.0, 0.0, 39.0, 90.0), ("d", 1, "i", 1, 0.0, 0.0, 90.0, 90.0), ("d", 2, "i", 0, 0.0, 0.0, 40.0, 40.0)],
        "document_id string, page_number int, image_id string, seq int, x0 double, y0 double, x1 double, y1 double",
    )
    kept = st.figures(figs)
    assert [r.page_number for r in kept.collect()] == [2]
    chunk = st.figure_chunks(kept.withColumn("caption", F.lit(""))).first()
    assert chunk.content == "[Figure] Figure on page 2" and chunk.caption == "Figure on page 2"
    tabs = spark.createDataFrame([("d", 1, 0, rows, "", None)], f"document_id string, page_number int, seq int, rows {kind}, raw string, image_key string")
    assert st.table_chunks(tabs).count() == 3


def test_files_and_parsers(spark):
    d = Path(tempfile.mkdtemp(prefix="spark-"))
    for name in ("a.txt", "b.PDF", "c", "d.exe"):
        (d / name).write_text("x")
    files = parsing.read_files(spark, str(d)).withColumn("mime", F.when(F.col("path").endswith("/c"), "text/plain"))
    ok, bad = parsing.admit_files(files, "mime")
    assert sorted(Path(r.path).name for r in ok.collect()) == ["a.txt", "b.PDF", "c"] and bad.count() == 1
    big = files.withColumn("length", F.lit(parsing.MAX_BYTES + 1))
    assert parsing.admit_files(big, "mime")[0].count() == 0
    assert [one(spark, x, parsing.parser_for) for x in ("Application/PDF", "msword", "md")] == ["pdf", "docx", "text"]

    def broken(raw):
        raise ValueError

    df = spark.createDataFrame([(1, "p1\fp2"), (2, " ")], "id int, raw string")
    chain = [("broken", broken), ("empty", lambda raw: [""]), ("split", lambda raw: raw.split("\f"))]
    got = [(r.id, r.page_number, r.content, r.parser) for r in parsing.extract_pages(df, "id", "raw", chain).collect()]
    assert got == [(1, 1, "p1", "split"), (1, 2, "p2", "split")]


def test_json_sources(spark):
    d = Path(tempfile.mkdtemp(prefix="spark-"))
    (d / "c.json").write_text(json.dumps({"cases": [{"question": "q", "relevant_keywords": ["a"]}, {"question": "r", "category": "x"}]}))
    (d / "n.json").write_text(json.dumps({"items": [{"claim": "c", "evidence": "e", "label": "neutral"}]}))
    assert [r.category for r in tables.load_cases(spark, str(d / "c.json")).collect()] == ["general", "x"]
    assert tables.load_claims(spark, str(d / "n.json")).first().label == "neutral"
    chunks = spark.createDataFrame([("d", "text", 1, 0, 1, "small")], "document_id string, content string, page_number int, chunk_index int, token_count int, granularity string")
    out = str(d / "out")
    tables.write_chunks(chunks, out)
    part = next(Path(out).glob("part*"))
    part.with_name("part-extra.json").write_text("\n\n" + part.read_text())
    assert tables.read_chunks(spark, out).count() == 2


def test_snapshots_and_access(spark):
    assert [r.id for r in tenancy.accessible_workspaces(spark.createDataFrame([("a",), ("b",)], "id string"), "a").collect()] == ["a"]
    ws = spark.createDataFrame([("a",), ("b",)], "id string")
    assert tenancy.accessible_workspaces(ws, None).count() == 0 and tenancy.accessible_workspaces(ws, None, True).count() == 2
    docs = spark.createDataFrame([("a", "w"), ("b", None)], "document_id string, workspace_id string")
    assert docs.where(tenancy.document_filter("w")).count() == 1 and docs.where(tenancy.document_filter(None)).count() == 2
    sizes = spark.createDataFrame([(0,), (1,), (1536,), (5 * 1024**3,)], "n long")
    assert [r.s for r in sizes.select(tenancy.file_size(F.col("n")).alias("s")).collect()] == ["0 Bytes", "1 Bytes", "1.5 KB", "5 GB"]
    late = spark.createDataFrame([("a", "2024-01-01 00:00:00")], "document_id string, started_at string").withColumn("status", F.lit("processing"))
    none = spark.createDataFrame([], "document_id string")
    assert tenancy.finalize_status(late, none, "2024-01-01 00:05:01").first().error_message == tenancy.TIMED_OUT
    assert tenancy.finalize_status(late, none, "2024-01-01 00:05:00").first().error_message == tenancy.NO_CONTENT


def test_metrics_and_quality(spark):
    key = metrics.metric_key(F.lit("m"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    assert spark.range(1).select(key.alias("k")).first().k == 'm{a="1",b="2"}'
    pts = spark.createDataFrame([("p", float(i), i) for i in range(1500)], "path string, v double, i long")
    s = metrics.latency_summary(pts, "path", "v", ["i"], kept=1000).first()
    assert (s["count"], s["min"], s["p50"], s["p95"], s["p99"]) == (1000, 500.0, 1000.0, 1450.0, 1490.0)
    few = metrics.latency_summary(pts.where("i < 19"), "path", "v", ["i"]).first()
    assert few.p95 == 18.0
    df = spark.createDataFrame([("The cat-sat!", "the  cat-sat")], "p string, t string")
    assert df.select(ev.token_f1(F.col("p"), F.col("t")).alias("f")).first().f == 1.0
    judged = spark.createDataFrame([(1, 1, False), (1, 3, True), (1, 4, True)], "query_id int, rank int, relevant boolean")
    cases = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: (r.recall, r.mrr, r.precision) for r in ev.per_case(cases, judged, 5).collect()}
    assert got == {1: (1, 1 / 3, 0.4), 2: (0, 0.0, 0.0)}


def test_slots(spark):
    from lodestone.functions import vectors as vec

    df = spark.createDataFrame([("a", "t", "h1"), ("b", "t", "h1"), ("c", "u", "h2")], "id string, text string, h string")
    known = spark.createDataFrame([("h1", [1.0, 2.0])], "h string, vec array<float>")
    got = {r.id: list(r.vec) for r in slots.embed_once(df, "text", "h", lambda c: vec.lexical_counts(c, 2), known).collect()}
    assert got["a"] == got["b"] == [1.0, 2.0] and len(got["c"]) == 2
    fail = slots.guarded(lambda c: F.lit(None).cast("array<float>"), 3)
    assert one(spark, "x", fail) == [0.0, 0.0, 0.0]
    img = spark.createDataFrame([("k", None, "words"), (None, "c", "w")], "img string, cap string, text string")
    vis = slots.embed_visual(img, "img", "cap", "text", lambda c: vec.lexical_counts(c, 4)).collect()
    assert vis[0].clip_vec is not None and vis[1].clip_vec is None


def test_cache_lookup_order(spark):
    e = spark.createDataFrame([("n", "e1", "Hi there", [1.0, 0.0]), ("m", "e2", "hi there", [1.0, 0.0])], "ns string, entry_id string, query string, vec array<double>")
    kept = cache.store(e.withColumn("stored_at", F.lit("2024-01-01").cast("timestamp")))
    asked = spark.createDataFrame(
        [(1, "n", " hi THERE ", [1.0, 0.0]), (2, "n", "hello", [0.95, 0.3122499]), (3, "n", "far", [0.5, 0.5]), (4, "k", "hi", [1.0, 0.0])],
        "query_id long, ns string, query string, vec array<double>",
    )
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    assert [(r.query_id, r.entry_id) for r in cache.semantic_lookup(asked, kept, now).collect()] == [(2, "e1")]
    assert cache.semantic_lookup(asked, kept, F.lit("2024-01-03").cast("timestamp")).count() == 0


def test_exact_lookup_answers_every_request_once(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    stored = [("n", "Foo", at(1)), ("n", "foo ", at(1)), ("n", "foo", at(3)), ("m", "foo", at(9)), ("n", "newest", at(1))]
    kept = cache.store(spark.createDataFrame(stored, "ns string, query string, s string").withColumn("stored_at", F.col("s").cast("timestamp")))
    asked = [(1, "n", "FOO", at(0)), (2, "n", "foo", at(1)), (3, "n", "foo", at(12)), (4, "m", "foo", at(8)), (5, "n", "newest", at(3)), (6, "n", "newest", at(1)), (7, "k", "foo", at(5)), (7, "k", "foo", at(5))]
    df = spark.createDataFrame(asked, "id long, ns string, query string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = sorted((r.id, r.hit) for r in cache.exact_lookup(df, kept).collect())
    assert got == [(1, False), (2, True), (3, True), (4, False), (5, False), (6, True), (7, False), (7, False)]
    alive = cache.live(kept, F.lit(at(2)).cast("timestamp")).select("ns", "query").collect()
    assert sorted(map(tuple, alive)) == [("n", "Foo"), ("n", "foo ")]


def test_latency_percentiles_of_many_values(spark):
    values = [((i * 7919) % 5000) / 10 for i in range(5000)] + [3.5] * 3000
    df = spark.createDataFrame([("p", v) for v in values] + [("q", 1.0), ("r", None)], "path string, v double")
    got = {r.path: r for r in metrics.latency_summary(df, "path", "v", []).collect()}
    v = sorted(values)
    assert (got["p"].p50, got["p"].p95, got["p"].p99) == (v[4000], v[7600], v[7920]) and got["p"]["count"] == 8000
    assert got["q"].p50 == got["q"].p99 == 1.0 and "r" not in got


def test_bad_json_is_an_empty_array(spark):
    assert one(spark, "{oops", lambda c: cv.parse_json_array("x", "string")) == []
    assert one(spark, '["a"]', lambda c: cv.parse_json_array("x", "string")) == ["a"]


def test_plans(spark):
    """Scans read only what they need and vectors do not travel past scoring."""
    from lodestone.plans.views import Views

    t = Views(spark, "/root/testdata/sf0.001")
    plan = tenancy.ready_documents(t.docs, "src1").select("document_id")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[-1]
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)" in plan
