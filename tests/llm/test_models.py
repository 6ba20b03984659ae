"""Fitted operators on the given tables, and the pipeline on a small corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import language, quality
from lodestone.llm.common import crc_remainder, read_table, store

FOLDER = "/root/testdata/sf0.01"


def test_factorisation_machine_separates_held_out_labels(spark):
    out = quality.op2_quality(spark, FOLDER).join(read_table(spark, FOLDER, "labels"), "doc_id").filter("held_out").collect()
    assert len(out) > 40 and sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    size = quality.BUCKETS + quality.BINS
    model = quality.Model(np.linspace(0, 1, quality.BINS - 1)[None], 0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)))
    found = [(np.array([3, 8, 11]), np.array([0.5, 0.2, 0.1]), [0.4]), (np.array([], np.int64), np.array([]), [2.0])]
    index, x, row = quality.flatten(model, found)
    got = model.raw(index, x, row, 2)[0]
    for r in (0, 1):
        i, v = index[row == r], x[row == r]
        pairs = sum(float(model.factor[i[a]] @ model.factor[i[b]]) * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(got[r] - (0.3 + model.weight[i] @ v + pairs)) < 1e-9


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, None)], "doc_id long, quality int")
    rows = [(i, "###!!! " * 30 if i % 2 == 0 else "words of a plain sentence " * 8, 100) for i in range(200)] + [(300, None, None), (301, "", 0), (301, "", 0), (302, "long text " * 20000, 200000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("score", F.lit("x")).withColumn("c0", F.lit(1))
    out = quality.scored(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["_score"] <= 1 for r in out)
    assert all((r["_score"] > 0.5) == (r.doc_id % 2 == 1) for r in out if r.doc_id < 200)
    none = quality.scored(docs, labels.limit(0)).select("_score").distinct().collect()
    assert [r[0] for r in none] == [0.5] and quality.scored(docs.limit(0), labels).count() == 0


def test_languages_of_held_out_documents(spark):
    out = language.op6_language(spark, FOLDER).join(read_table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 200 and sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)


def test_spans_of_mixed_text(spark):
    docs = read_table(spark, FOLDER, "documents")
    model = language.fit(docs, crc_remainder("doc_id", 4) != 2, "doc_id", "text", "lang", 100)
    held = {r.lang: r.text for r in docs.filter((crc_remainder("doc_id", 4) == 2) & (F.length("text") > 1500)).collect()}
    en, fr = held["en"].split()[:120], held["fr"].split()[:60]
    rows = [(1, " ".join(en[:60] + fr + en[60:])), (2, None), (3, "12 34 !!"), (4, ""), (5, "слово из других букв"), (6, " ".join(en) * 300), (6, " ".join(en) * 300)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(1)), model).collect()}
    assert [s["lang"] for s in got[1].spans] == ["en", "fr", "en"] and abs(got[1].spans[1]["start"] - 60) <= 3
    assert all(got[i].lang == "und" and got[i].score == 0 and got[i].spans == [] for i in (2, 3, 4))
    assert got[6].lang == "en" and got[5].lang in model.langs
    empty = language.fit(docs.limit(0), F.lit(True), "doc_id", "text", "lang", 100)
    assert {r.lang for r in language.identify(docs.limit(5), empty).collect()} == {"und"}


def test_a_viterbi_step_needs_more_than_the_penalty():
    model = language.Model({"a": ["aba abba baab"] * 5, "b": ["cdc cddc dccd"] * 5})
    labels, letters, sizes = language.Tagger(model, 1e9).label(["abba cdc abba aba", ""])
    assert labels.tolist() == [0] * 4 and letters.tolist() == [4, 3, 4, 3] and sizes.tolist() == [4, 0]
    assert language.Tagger(model, 0.0).label(["abba cdc abba"])[0].tolist() == [0, 1, 0]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with the documents of the small tables and planted rows."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = read_table(spark, FOLDER, "documents")
    clean = docs.join(read_table(spark, FOLDER, "labels").filter("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").filter(F.length("text") > 800).limit(3).collect()
    item = read_table(spark, FOLDER, "benchmark").filter(F.length("text") > 150).first().text
    words = clean[1].text.split(" ")
    near = " ".join([*words[:50], "changed", *words[51:]])
    planted = [(90001, clean[0].text), (90002, near), (90003, clean[2].text[:400] + "\n" + item), (90004, "!!! ### " * 60), (90005, None), (90006, "")]
    rows = spark.createDataFrame([(i, t, "en", None, None) for i, t in planted], docs.schema)
    docs.unionByName(rows).unionByName(rows.filter("doc_id = 90006")).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        read_table(spark, FOLDER, name).write.parquet(f"{folder}/{name}.parquet")
    return folder, [r.doc_id for r in clean]


def test_pipeline_stages_do_what_they_say(spark, corpus):
    folder, clean = corpus
    docs, seen = read_table(spark, folder, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, folder), name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
    assert 90004 not in seen["quality_classifier"] and {*clean, 90001, 90002, 90003} <= seen["quality_classifier"]
    assert seen["line_dedup"] == seen["quality_classifier"]
    assert not {90001, 90002} & seen["near_dedup"] and clean[0] in seen["near_dedup"]
    assert 90003 in seen["near_dedup"] and 90003 not in seen["decontamination"]
    assert seen["packing"] == seen["decontamination"] <= seen["near_dedup"]
    whole = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("n")).collect()}
    assert all(whole.values())


def test_pipeline_of_no_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        read_table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
