"""Ranked search, secrets and hard negatives against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import negatives, ranked_search, secret_scan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranking(docs, items, k):
    """item row -> [(score, doc_id)] by the formula, over all pairs."""
    words = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    counts = [(d, len(w), Counter(w)) for d, w in words if w]
    n, total = len(counts), sum(c[1] for c in counts)
    df = Counter(t for c in counts for t in c[2])
    out = []
    for item, text in items:
        asked, hits = Counter(TERM.findall((text or "").translate(LOWER))), []
        for d, size, tf in counts:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, q in asked.items() if tf[t])
            if score > 0 and d is not None:
                hits.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def test_dual_trees_equal_scoring_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÉCOLE", "naïve"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 60))) for _ in range(700)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(700 + i, texts[3]) for i in range(90)] + [(3, texts[3]), (None, texts[4]), (900, None), (901, ""), (902, "... --"), (903, "w1 W1\tw2 " * 30000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(70)] + [(5, texts[3]), (5, texts[3]), (70, None), (71, ""), (72, "unseen words")]
    want = brute_ranking(docs, items, 20)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("id", F.lit(1)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("place", F.lit(0)).withColumn("terms", F.lit("y"))
    for limits in ({}, {"block_terms": 100, "shares": (1, 4)}):
        got = sorted(tuple(r) for r in ranked_search.search(d, i, **limits).select("item_id", "rank", "doc_id", "score").collect())
        assert got == want
    assert ranked_search.search(d.limit(0), i).count() == 0 and ranked_search.search(d, i.limit(0)).count() == 0


def test_node_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(80, rng.integers(1, 20), replace=False)) for _ in range(500)]
    rows = ranked_search.Rows(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets), rng.integers(1, 1000, sum(map(len, sets))))
    dense, every = rng.integers(0, 50, 80), np.arange(500)
    exact, levels = rows.dots(every, dense), ranked_search.tree(rows, 4, 8)
    for up, level in enumerate(reversed(levels)):
        assert (level.dots(np.arange(len(level)), dense)[every // 4**up] >= exact).all()


def test_secrets_of_odd_texts(spark):
    rng = random.Random(9)
    parts = ["con", "fig", "ura", "tion", "get", "set", "tings", "Account", "user", "max", "_value", "ship", "port", "able", "un", "der", "stand", "ing", "Index", "item", "_of_"]
    words = sorted({"".join(rng.choices(parts, k=rng.randint(3, 6))) for _ in range(6000)})
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    loose = ["".join(rng.choices(alphabet, k=32)) for _ in range(10)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + f"ä api_key = '{''.join(rng.choices(alphabet, k=24))}' " + " ".join(rng.choices(words, k=5))) for i in range(60)]
    rows += [(100 + i, f"{rng.choice(words)} {s} \U0001f511 {rng.choice(words)}") for i, s in enumerate(loose)]
    rows += [(200, "x" * 100000 + " PassWord:abcdefgh token=short AKIA" + "A1" * 8 + " " + "0123456789abcdef" * 2), (201, None), (202, ""), (203, "paſſword = longenough1"), (200, "token token=" + "a" * 8 + " secret" + " " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("c0", F.lit(1)).withColumn("_secrets", F.lit(2))
    model = secret_scan.train(docs)
    got = [(r.doc_id, r.text, r["found"]) for r in secret_scan.scan(docs, model, name="found").collect()]
    assert sorted((i, t or "") for i, t, _ in got) == sorted((i, t or "") for i, t in rows)
    for i, text, spans in got:
        base = [(s["kind"], s["start"], s["end"]) for s in spans if s["kind"] != "markov"]
        assert base == brute_secrets(text or "")
        more = [(text or "")[s["start"] : s["end"]] for s in spans if s["kind"] == "markov"]
        assert more == ([loose[i - 100]] if 100 <= i < 110 else [])
    assert secret_scan.scan(docs.limit(0), model).count() == 0 and secret_scan.train(docs.limit(0)) is None
    assert all(s["kind"] != "markov" for r in secret_scan.scan(docs, None, name="found").collect() for s in r["found"])


def brute_secrets(text):
    """The three patterns as stated, matches that are too short dropped afterwards."""
    found = []
    kinds = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_secret_digests_of_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    for r in secret_scan.op12_secrets(spark, folder).collect():
        base = brute_secrets(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]


def test_residue_products_are_exact():
    rng = np.random.default_rng(5)
    for d, size in ((1, 3), (64, 300), (64, 1 << 28), (700, 1 << 26), (2000, 5)):
        a, b = rng.integers(-size, size + 1, (9, d)), rng.integers(-size, size + 1, (13, d))
        a[0], b[0], b[1] = size, size, -size
        primes = negatives.primes_for(d * size**2)
        got = negatives.score_matrix([negatives.residues(a, p) for p in primes], [negatives.residues(b, p) for p in primes], primes)
        assert got.tolist() == [[sum(x * y for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]


def brute_negatives(rows, is_anchor):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for r in sorted(good):
        if is_anchor(r[0]):
            anchors.setdefault(r[0], r)
    out = []
    for a, label, v in anchors.values():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l == label) for i, l, w in good if i != a)
        for p, i, _ in [s for s in scored if s[2]][:5]:
            inside = [(j, -s) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, i, r + 1, j, -p, s) for r, (j, s) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 1024)
    rng = np.random.default_rng(8)
    vectors = np.round(rng.normal(0.4, 1, (900, 6)), 1).tolist()
    rows = [(i, 1 if i % 3 == 0 else int(rng.integers(0, 4)), v) for i, v in enumerate(vectors)]
    rows += [(1000 + i, 1, vectors[0]) for i in range(200)] + [(30, 2, vectors[5]), (31, 1, vectors[6]), (31, 1, vectors[6])]
    rows += [(40, None, vectors[1]), (None, 1, vectors[1]), (41, 1, None), (42, 1, [None] + vectors[1][1:]), (43, 1, [float("nan")] + vectors[1][1:]), (44, 1, [float("inf")] + vectors[1][1:]), (45, 1, [1.0]), (46, 1, []), (50, 9, [0.0] * 6)]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("x")).withColumn("g", F.lit(1)).repartition(3)
    whole = negatives.whole_vectors(df, "vec_id", "embedding", F.col("label"), 256)
    got = negatives.mine(whole, F.col("id") % 10 == 0, block_rows=40)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and len(want) > 1000
    assert negatives.mine(whole.limit(0), F.col("id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(negatives.whole_vectors(df, "vec_id", "embedding", F.col("label"), 1 << 31), F.lit(True))
