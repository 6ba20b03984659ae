"""Operators with an exact result, against brute force on small tables."""

import collections
import hashlib
import pathlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import components, decontaminate, licenses, neighbours, packing, simhash, site_lines, substrings, url_rules

DOCS = "doc_id long, text string, source string, n_chars long"


def texts(seed=1, n=60, words=120):
    """Random texts with exact copies, near copies, shared passages, repeats inside a text, empty and missing texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, out = draw(60), []
    for i in range(n):
        w = draw(rng.randint(1, words))
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) : rng.randint(46, 60)]
        out.append(" ".join(w))
    out += [out[3], out[5], out[5].replace(" ", "\n\t "), out[10].upper(), " ".join(passage * 2), "the " * 200, "the " * 300, "", " \n ", None, None]
    near = out[8].split()
    near[len(near) // 2] = "changed"
    return [*out, " ".join(near), "Ünïcode Éclair " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s0" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[7], rows[65]], DOCS).repartition(3)  # repeated rows


def test_substrings_match_counting_all_windows(docs):
    rows = docs.select("doc_id", "text").collect()
    words = [(r.text or "").encode().split() for r in rows]
    counts = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((r.doc_id, sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    for shard_contents in (1000, 1):  # automata, and the way for crowded seeds
        out = substrings.clean(docs.withColumn("_t", F.lit(1)).withColumn("bits", F.lit("x")), shard_contents=shard_contents)
        got = [(r.doc_id, sum(s["words"] for s in r["_spans"]), hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect()]
        assert sorted(got) == sorted(want)
    assert sum(n for _, n, _ in want) > 500


def test_suffix_automaton_counts_every_substring():
    rng = random.Random(3)
    for _ in range(40):
        seqs = [[rng.choice("ab") for _ in range(rng.randint(1, 14))] for _ in range(3)]
        weights = [rng.randint(1, 3) for _ in seqs]
        automaton = substrings.SuffixAutomaton()
        for s, w in zip(seqs, weights):
            automaton.add(s, w)
        automaton.close()
        for size in (1, 2, 3, 5):
            counts = collections.Counter()
            for s, w in zip(seqs, weights):
                for i in range(len(s) - size + 1):
                    counts[tuple(s[i : i + size])] += w
            for s in seqs:
                got = list(automaton.window_counts(s, size))[size - 1 :]
                assert got == [counts[tuple(s[i : i + size])] for i in range(len(s) - size + 1)]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_links_every_pair_within_two_bits(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = brute_groups(fps, pairs)
    got = simhash.near_copies(docs.withColumn("fp", F.lit(0)).withColumn("id", F.lit("x"))).collect()
    assert len(got) == len(rows)
    assert all(r["fp"] & (2**64 - 1) == fps[r.doc_id] and r.component_id == want[r.doc_id] for r in got)


def test_popcount_grid_finds_all_links(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for x in base:
        for k in (1, 2, 3, 8, 9):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for distance, groups in ((2, ((8,) * 8,)), (8, simhash.WIDE_GROUPS)):
        got = {tuple(sorted((r.a, r.b))) for r in simhash.links(df, distance, groups).collect()}
        assert got == {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}


def test_probes_of_the_grid_are_never_broadcast(spark):
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    found = simhash.links(fps)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(139, 200), (50, 49), (49, 50), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_groups({x for e in edges for x in e} - set(), [(a, b) for a, b in edges if a != b])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_leave_one_of_each_group(docs):
    clash = docs.withColumn("t1", F.lit(1)).withColumn("u", F.lit("x"))
    out = simhash.drop_near_copies(clash)
    assert out.columns == clash.columns
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows}
    jaccard = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    want = brute_groups(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))



def kept_and_wanted(spark, texts):
    """Ids that drop_near_copies leaves, and those that brute force leaves."""
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)
    return sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()), sorted(set(brute_groups(sets, pairs).values())), sets


def test_near_copies_meet_by_their_fingerprints_first(spark):
    prints = [0, 3, 7, 7, 7, 1 << 40, 255]
    nodes = spark.createDataFrame(list(enumerate(prints)), "n long, fp long")
    got = {(r.a, r.b) for r in simhash._near_prints(nodes).collect()}
    heads = [(i, x) for i, x in enumerate(prints) if prints.index(x) == i]
    near = {(i, j) for i, x in heads for j, y in heads if i < j and (x ^ y).bit_count() <= 2}
    assert got == near | {(2, 3), (2, 4)} and (0, 1) in got and (1, 2) in got


def test_near_copies_of_every_band_are_found(spark):
    rng, out = random.Random(11), []
    for edits in range(1, 12):
        for _ in range(8):
            w = [f"w{rng.randrange(3000)}" for _ in range(300)]
            near = list(w)
            for at in rng.sample(range(300), edits):
                near[at] = f"x{rng.randrange(3000)}"
            out += [" ".join(w), " ".join(near)]
    got, want, sets = kept_and_wanted(spark, out)
    bands = collections.Counter(int(20 * len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])) for i in range(0, len(out), 2))
    assert all(bands[b] for b in (16, 17, 18, 19)) and got == want



def test_near_copies_of_one_fingerprint_are_compared_with_each_other(spark):
    rng, out = random.Random(12), []
    filler = "the " * 400  # one shingle is over half of all, so that SimHashes are equal
    for _ in range(6):
        w = [f"w{rng.randrange(3000)}" for _ in range(150)]
        near = list(w)
        near[70] = "changed"
        out += [filler + " ".join(w), filler + " ".join(near), filler + " ".join(w[:149])]
    assert len({simhash.majority(simhash.shingle_hashes(t, 5)) for t in out}) == 1
    got, want, _ = kept_and_wanted(spark, out)
    assert got == want == [0, 3, 6, 9, 12, 15]


def test_decontamination_equals_counting_windows(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    items = [(0, texts()[1][:200]), (1, "w1 w2"), (2, ""), (3, None), (None, "w3"), (4, texts()[5]), (4, "the"), (5, "no such words")]
    got = decontaminate.contamination(docs.withColumn("_digest", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    cut = lambda t: decontaminate_words(t)
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for r in rows:
        w = cut(r.text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want.append((r.doc_id, len(w), len(hit), sorted(found)))
    assert sorted((r.doc_id, r["_hits"].n_words, r["_hits"].n_hit, r["_hits"]["items"]) for r in got) == sorted(want)
    assert any(x[2] for x in want)


def decontaminate_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_site_lines_are_relative_to_their_host(spark):
    rows = [(i, f"menu \nbody {i}\n\nfoot", "a", 1) for i in range(10)] + [(20 + i, f"foot\nother {i}", "b" if i else None, 1) for i in range(4)]
    rows += [(30, None, "a", 1), (31, "", "a", 1), (32, "menu\nmenu", "a", 1), (32, "menu\nmenu", "a", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_salt", F.lit(9)).withColumn("_lines", F.lit(9))
    out = site_lines.drop_lines(df, name="cut")
    assert out.columns == [*df.columns, "cut"]
    got = sorted((r.doc_id, r.text, r["cut"].total, r["cut"].dropped) for r in out.collect() if r.text is not None)
    want = [(i, f"body {i}\n", 4, 2) for i in range(10)] + [(20 + i, f"foot\nother {i}", 2, 0) for i in range(4)] + [(31, "", 1, 0), (32, "", 2, 2), (32, "", 2, 2)]
    assert got == sorted(want)
    assert site_lines.drop_lines(df.limit(0)).count() == 0



def test_full_licence_texts(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    rows = [(want, (folder / f).read_text()) for f, want in files.items() if (folder / f).exists()]
    bsd = licenses.BSD_TWO.replace("above copyright notice, this list", "above copyright notice, this\n   list")
    rows += [("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2021, Somebody\n\n" + bsd + licenses.BSD_END), ("BSD-3-Clause", "Copyright 2021 Somebody\n" + bsd + licenses.BSD_THREE + licenses.BSD_END)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r.license == r.doc_id for r in got)


def test_licences_by_canonical_text(spark):
    mit = "The MIT Licence\n\nCopyright (c) 2020 Somebody\n\n" + licenses.MIT_BODY.replace("copyright holders", "COPYRIGHT OWNERS").replace('"', "''")
    rows = [(1, mit), (2, "intro\nReleased under the MIT licence!\nmore"), (3, None), (4, ""), (5, "Copyright 2020"), (6, mit + " extra"), (6, mit + " extra")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))).collect()}
    assert got[1].license == "MIT" and got[2].license is None and got[2].notices == ["MIT"]
    assert all(got[i].digest is None and got[i].license is None and got[i].notices == [] for i in (3, 4, 5)) and got[6].license is None


def test_url_rules_prefer_the_longest(spark):
    urls = ["http://example.com/en/x", "https://www.Example.com/en/", "http://a.b.net/es/q?u=/fr/", "x://net/fr/1", "http://com", "http://com/", "http://notexample.com/en/", "no url", None, "a://", "http://a.net#/es/", "http://e.org/en/", "http://.com/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:3])], "page_id long, url string")
    rules = spark.createDataFrame([*url_rules.RULES, ("net", "/es/", "allow"), ("org", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}

    def brute(url):
        host, path = url_rules.split_url(url)
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in [tuple(r) for r in rules.collect()] if p and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")

    assert got == {i: brute(u) for i, u in enumerate(urls + urls[:3])}
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_packing_is_an_exact_round_trip(docs):
    from tokenizers import Tokenizer

    extra = docs.unionByName(docs.limit(1).select(F.lit(900).cast("long").alias("doc_id"), F.repeat(F.lit("one two three, "), 3000).alias("text"), "source", "n_chars"))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack(extra, packing.default_tokenizer(), window=64).collect()
    want = collections.Counter((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in extra.collect())
    ids = lambda p: tuple(np.frombuffer(p.ids, "<u4").tolist())
    got = collections.defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    for (doc, whole), copies in want.items():
        own = collections.Counter((p.start, ids(p)) for p in got[doc] if p.doc_tokens == len(whole))
        covered = collections.Counter(i for (start, part), k in own.items() for i in range(start, start + len(part)) for _ in range(k))
        assert all(whole[s : s + len(part)] == part for s, part in own)
        assert covered == collections.Counter({i: copies for i in range(len(whole))})
    rows = collections.defaultdict(list)
    for p in pieces:
        rows[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding == 0 and sum(len(w) * k for (_, w), k in want.items()) == sum(p.length for p in pieces)
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0
    assert zlib.crc32(b"") == 0


def test_least_squares_uses_what_the_histogram_has():
    histogram = np.zeros(65, np.int64)
    histogram[[40, 24, 30, 34, 10, 64]] = [50, 50, 20, 20, 12, 7]
    patterns = packing.combinations(histogram, 4, 4096)
    assert all(sum(p) == 64 for p in patterns) and (40, 24) in patterns and (64,) in patterns
    plan = packing.Plan(histogram)
    spots = [s for length in range(1, 65) for n in range(int(histogram[length])) for s in plan.place(length, n)]
    filled = collections.Counter()
    for size, sequence, _ in spots:
        filled[sequence] += size
    assert sum(filled.values()) == sum(i * int(k) for i, k in enumerate(histogram))
    assert all(v <= 64 for v in filled.values()) and len({(s, o) for _, s, o in spots}) == len(spots)


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:760] = x[5]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [1.0, None] * 12), (5400, [1.0]), (5, x[5].tolist())]
    df = neighbours.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert df.count() == 1500
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.filter("id % 100 = 0 OR id = 5"), shard_rows=400, beam=96).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits, y = 0, x.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hits += len(set(order) & {v for v, _ in found})
        assert all(abs(d[v] - s) < 1e-9 for v, s in found) and len(found) == 10
    assert hits >= 0.9 * 10 * len(got)
    assert [v for v, _ in got[5]] == list(range(700, 710))
    few = df.filter("id < 4")
    assert neighbours.nearest(few, few).count() == 12 and neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


def test_pairs_of_a_frequent_shingle_are_found_in_blocks_and_only_near_ones_become_rows(spark, monkeypatch):
    """Texts that share a first shingle but little else: the join of their components made a row of each pair."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = []
    for j in range(40):
        own = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        sets.append(np.concatenate([shared, own]))
        if j % 4 == 0:
            sets.append(np.concatenate([shared, own[:55], rng.integers(0, 1 << 63, 5).astype(np.uint64)]))
    rows = [(n, len(x), 0, 77, n) for n, x in enumerate(sets)] + [(n, len(x), 1, 78, n) for n, x in enumerate(sets[:3])]
    made = spark.createDataFrame(rows, "n long, k long, i long, s long, root long")
    nodes = spark.createDataFrame([(n, bytearray(simhash._sketch(x))) for n, x in enumerate(sets)], "n long, sketch binary")
    found = sorted(tuple(r) for r in simhash._across(made, nodes, 0.8).collect())
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert len(similar) == 10 and similar <= set(found) and len(found) == len(set(found)) < 30, found
    joined = made.withColumn("root", F.lit(0).cast("long"))
    assert simhash._across(joined, nodes, 0.8).count() == 0


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Each round of stars writes a table and shuffles six times, whatever the number of links: a chain of 300 links took many."""
    made, store = [], components.store
    monkeypatch.setattr(components, "store", lambda df, name: made.append(name) or store(df, name))
    rng = np.random.default_rng(3)
    edges = [(int(i), int(i) + 1) for i in rng.permutation(300)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (300, 2))]
    want = brute_groups({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.root for r in components.components(frame).collect()} == {n: r for n, r in want.items() if n in linked}
    assert len(made) == 2
    for most in (40, 7):
        monkeypatch.setattr(components, "TASK_LINKS", most)
        got = components.components(frame).collect()
        assert len(got) == len(linked) and {r.node: r.root for r in got} == {n: r for n, r in want.items() if n in linked}
