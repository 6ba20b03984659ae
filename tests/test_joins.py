"""Cosine join, version chains and covers against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import cosine_join, lexical, tenancy


def test_cosine_join_finds_every_pair(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(160):
        v = np.zeros(40)
        v[rng.choice(40, 6, replace=False)] = rng.integers(-3, 4, 6)
        rows += [v, v + (rng.random(40) < 0.03)]
    rows += [np.ones(40)] * 60 + [np.zeros(40)]
    a = [(i, f"n{i % 3}" if i % 7 else None, [float(x) for x in v]) for i, v in enumerate(rows)] + [(9000, "n1", None)]
    left = spark.createDataFrame(a, "l long, ns string, vec array<double>")
    right = left.select((F.col("l") + 10_000).alias("r"), "ns", "vec")
    for threshold in (0.6, 0.95):
        want = set()
        live = [(i, ns, np.array(v)) for i, ns, v in a if v is not None and any(v)]
        for i, n, v in live:
            for j, m, w in live:
                score = round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 6)
                if n == m and score >= threshold:
                    want.add((i, j + 10_000, score))
        got = {tuple(x) for x in cosine_join.join(left, right, threshold, "l", "r", ("ns",)).collect()}
        assert {g[:2] for g in got} == {w[:2] for w in want} and len(want) > 1000
    assert cosine_join.join(left.limit(0), right, 0.9, "l", "r").count() == 0
    assert cosine_join.join(left, right.limit(0), 0.9, "l", "r").count() == 0


def test_version_chains_of_any_shape(spark):
    rng = random.Random(2)
    prev = {str(i): (str(i - 1) if i % 70 else None) for i in range(210)}
    prev |= {f"star{i}": "0" for i in range(60)}
    prev |= {"x": "y", "y": "z", "z": "x", "into": "x", "self": "self", "lost": "no such document"}
    rows = list(prev.items())
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "document_id string, previous_document_id string")

    def walk(d):
        depth, seen = 0, set()
        while prev.get(d) in prev:
            if d in seen:
                return None, None
            seen.add(d)
            d, depth = prev[d], depth + 1
        return d, depth

    ends = {d: walk(d) for d in prev}
    newest = {}
    for d, (root, depth) in ends.items():
        if root is not None:
            newest[root] = max(newest.get(root, (-1, "")), (depth, d))
    got = {r.document_id: (r.root, r.depth, r.newest) for r in tenancy.version_chain(docs).collect()}
    assert got == {d: (root, depth, newest[root][1] if root is not None else None) for d, (root, depth) in ends.items()}
    assert tenancy.version_chain(docs.limit(0)).count() == 0


def brute_covers(asked, text):
    words, terms = re.findall("[a-z0-9]+", text.lower()), set(re.findall("[a-z0-9]+", asked.lower()))
    spans = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if terms <= set(words[a : b + 1])]
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return round(min(1.0, sum(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in least)), 6) if terms and least else None


def test_cover_density_equals_testing_all_stretches(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 40)))) for i in range(80)] + [(90, ""), (91, None), (92, "a a a a a a a a a a a a a")]
    asked = [(1, "a b"), (2, "c"), (3, "a a b c"), (4, "a z"), (5, ""), (6, "h G f")]
    docs = spark.createDataFrame(texts, "chunk_id long, text string")
    places = lexical.positional_postings(docs, "chunk_id", F.col("text"))
    scores = lexical.cover_scores(spark.createDataFrame(asked, "query_id long, text string"), places, lexical.document_frequency(places), "chunk_id")
    got = {(r.query_id, r.chunk_id): r.score for r in scores.collect()}
    want = {(q, d): s for q, a in asked for d, t in texts if (s := brute_covers(a, t or "")) is not None}
    assert got == want and len(want) > 150
