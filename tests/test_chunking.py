import random

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunking as ch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def packed(sentences, target, overlap):
    """Straight restatement of the packing rule on plain strings."""
    out, parts, size = [], [], 0
    for s in sentences:
        if parts and size + len(s) > target:
            whole = " ".join(parts)
            out.append(whole)
            tail = whole[-overlap:] if len(whole) > overlap else whole
            parts, size = ([tail], len(tail)) if tail else ([], 0)
        parts.append(s)
        size += len(s) + 1
    if parts and " ".join(parts).strip():
        out.append(" ".join(parts))
    return out


def prose(rng, n):
    return " ".join(
        " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 30, 120]))).capitalize() + rng.choice(".!?") for _ in range(n)
    )


def test_packing_equals_plain_fold(spark):
    import re

    rng = random.Random(5)
    texts = ["One.", "One. Two! Three?", "x" * 3000 + ". Short. " + "y" * 2000 + "."] + [prose(rng, n) for n in range(1, 60)]
    df = spark.createDataFrame([(str(i), None, t) for i, t in enumerate(texts)], "document_id string, page_number int, content string")
    for target, overlap in ((300, 75), (20, 75), (50, 10), (5, 1)):
        cfg = ch.ChunkConfig(small_tokens=target, overlap_tokens=overlap, multi_granularity=False)
        rows = ch.chunk_rows(df, cfg).orderBy("document_id", "chunk_index").collect()
        got = {}
        for r in rows:
            got.setdefault(r.document_id, []).append(r.content)
        for i, t in enumerate(texts):
            assert got[str(i)] == packed(re.split(r"(?<=[.!?])\s+", t), target * 4, overlap * 4), (i, target)


def test_short_text_keeps_one_granularity_after_dedupe(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    df = spark.createDataFrame([("a", None, text)], "document_id string, page_number int, content string")
    assert ch.chunk_rows(df).count() == 2
    kept = ch.ingest(df, one_page=True).collect()
    assert [r.granularity for r in kept] == ["small"] and kept[0].selected


def test_pages_of_one_document_are_brought_together(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [("a", 2, text), ("a", 1, text), ("a", 3, text.upper()), ("b", 1, text)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, content string")
    got = sorted((r.document_id, r.page_number) for r in ch.ingest(df).collect())
    assert got == [("a", 1), ("a", 3), ("b", 1)]


def test_prune_limits(spark):
    def words(n):
        return " ".join(f"w{i:06d}x" for i in range(n))

    rows = [
        ("29", "text", words(40), 29), ("30", "text", words(40), 30), ("1200", "text", words(40), 1200),
        ("1201", "text", words(40), 1201), ("noise", "text", "ab .,;:!? " * 20, 50), ("same", "text", "same " * 100, 125),
        ("table", "table", "| a |", 1),
    ]
    df = spark.createDataFrame(rows, "id string, chunk_type string, content string, token_count int")
    keep = ch.keep_chunk(F.col("content"), F.col("token_count"), F.col("chunk_type"))
    assert sorted(r.id for r in df.where(keep).collect()) == ["1200", "30", "table"]


def select(spark, items, cfg):
    rows = [(i, float(s), t, y) for i, (s, t, y) in enumerate(items)]
    df = spark.createDataFrame([("d", rows)], "d string, c array<struct<id:int,score:double,token_count:int,chunk_type:string>>")
    out = df.select(F.inline(ch.select_for_embedding(F.col("c"), cfg))).collect()
    return [r.id for r in out if r.selected]


def test_selection_skips_what_does_not_fit_and_goes_on(spark):
    cfg = ch.ChunkConfig(top_share=0.8, budget_min=100, budget_max=100)
    items = [(9, 60, "text"), (8, 60, "text"), (7, 40, "text"), (6, 1, "text"), (5, 1, "text"), (0, 500, "table")]
    assert select(spark, items, cfg) == [0, 2, 5]
    assert select(spark, [(1, 50, "text")], ch.DEFAULT) == [0]
    tied = [(1, 10, "text")] * 5
    assert select(spark, tied, ch.DEFAULT) == [0, 1]
    assert select(spark, [(0, 5, "figure"), (0, 5, "table")], ch.DEFAULT) == [0, 1]


def test_paragraphs(spark):
    text = "# Title\nfirst line\nsecond line\n\nnext\n1. Intro\nbody\n---\nRESULTS:\n\n\nend"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tx.paragraphs(F.col("t")).alias("p")).first().p
    assert got == ["# Title", "first line second line", "next", "1. Intro", "body", "---", "RESULTS:", "end"]


def test_structured_chunks_follow_text(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    pages = spark.createDataFrame([("a", 1, text)], "document_id string, page_number int, content string")
    extra = spark.createDataFrame(
        [("a", 1, 0, "| a |", 1, "table", "Table: a", None)],
        "document_id string, page_number int, seq int, content string, token_count int, chunk_type string, caption string, image_key string",
    )
    got = {r.chunk_type: (r.chunk_index, r.selected) for r in ch.ingest(pages, structured=extra).collect()}
    assert got == {"text": (0, True), "table": (2, True)}


def test_walk_equals_a_plain_loop(spark):
    rng = random.Random(8)
    lists = [[], [3], [rng.randrange(9) for _ in range(tx.BLOCK)]] + [
        [rng.randrange(9) for _ in range(rng.choice([1, 63, 65, 128, 1000]))] for _ in range(20)
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    walked = tx.walk(
        F.col("x"),
        F.lit(0),
        lambda s, x: F.when(s + x <= 20, s + x).otherwise(x),
        lambda s, x: F.when(s + x > 20, s),
        "int",
    )
    for r in df.select("i", walked.alias("w")).collect():
        state, out = 0, []
        for x in lists[r.i]:
            if state + x > 20:
                out.append(state)
            state = state + x if state + x <= 20 else x
        assert (list(r.w.out), r.w.last) == (out, state), r.i


def test_selection_equals_plain_walk(spark):
    rng = random.Random(3)
    lists = [
        [(rng.randrange(50) / 7, rng.randrange(1, 40), rng.choice(["text", "text", "text", "table"])) for _ in range(n)]
        for n in (0, 1, 2, 64, 65, 700)
    ]
    cfg = ch.ChunkConfig(budget_min=10, budget_max=900)
    schema = "i int, a array<struct<score:double,token_count:int,chunk_type:string>>"
    df = spark.createDataFrame(list(enumerate(lists)), schema)
    for r in df.select("i", ch.select_for_embedding(F.col("a"), cfg).alias("a")).collect():
        items = lists[r.i]
        order = sorted((-s, j, t) for j, (s, t, kind) in enumerate(items) if kind == "text")
        limit = max(10, min(int(sum(t for _, _, t in order) * 0.5), 900))
        used, chosen = 0, set()
        for _, j, t in order[: max(1, int(len(order) * 0.4))]:
            if used + t <= limit:
                used += t
                chosen.add(j)
        assert [c.selected for c in r.a] == [kind == "table" or j in chosen for j, (_, _, kind) in enumerate(items)], r.i


def test_packing_time_is_linear_in_the_units(spark, tmp_path):
    """Every unit is a cut, the worst case; eight times the units may take twelve times as long, not 64 times."""
    import time

    took = {}
    for n in (8000, 32000, 256000):
        text = " ".join(f"Word number {i}." for i in range(n))
        spark.createDataFrame([(text,)], "content string").write.parquet(str(tmp_path / str(n)))
        df = spark.read.parquet(str(tmp_path / str(n)))
        start = time.time()
        assert df.select(F.size(ch.pack_cuts(tx.sentences(F.col("content")), 20, 5, 1))).first()[0] == n
        took[n] = time.time() - start
    assert took[256000] < 12 * max(took[32000], 0.5), took


def test_chunks_with_figures_equal_a_plain_fold_and_are_packed_without_one(spark):
    """A page's chunks come from one batch step; a fold over its units in the plan costs most of an index build."""
    import re

    rng = random.Random(11)
    blanks = [" ", "  ", "\n", " ", "  ", "\x1c", "\x85"]
    texts = ["", "...", " .  ", "x" * 500, "éé. \U0001f600! 中文? end", *(
        "".join("wé " * rng.randrange(9) + rng.choice("abc.!?ß") + rng.choice(blanks) for _ in range(n)) for n in (1, 5, 60, 400)
    )]
    df = spark.createDataFrame([(str(i), None, t) for i, t in enumerate([*texts, None])], "document_id string, page_number int, content string")
    for target, overlap in ((30, 5), (7, 75), (1, 0)):
        cfg = ch.ChunkConfig(small_tokens=target, large_tokens=2 * target, overlap_tokens=overlap, prune=False, dedup=False)
        kept = ch.ingest(df, cfg, one_page=True)
        folds = ch.chunk_rows(df, cfg)
        assert "aggregate(" not in folds._jdf.queryExecution().optimizedPlan().toString()
        wanted = set()
        for i, t in enumerate(texts):
            units = re.split(r"(?<=[.!?])[\s\x1c-\x1f\x85]+", t)
            for kind, size in (("small", target), ("large", 2 * target)):
                plain = fold(units, size * 4, overlap * 4)
                wanted |= {(str(i), kind, j, c) for j, c in enumerate(plain) if c.strip()}
        assert {(r.document_id, r.granularity, r.chunk_index, r.content) for r in folds.collect()} == wanted
        figures = {(r.content, r.alnum, r.unique) for r in kept.collect()}
        again = kept.select("content", tx.alnum_ratio(F.col("content")).alias("a"), tx.unique_ratio(F.col("content")).alias("u"))
        assert figures == {(r.content, r.a, r.u) for r in again.collect()}


def fold(units, limit, overlap):
    """Units one by one, the text carried over as a string."""
    out, text, size = [], None, 0
    for u in units:
        if text is not None and size + len(u) > limit:
            out.append(text)
            tail = text[len(text) - min(len(text), overlap) :]
            text, size = (tail, len(tail)) if tail else (None, 0)
        text = u if text is None else text + " " + u
        size += len(u) + 1
    return [*out, text] if text is not None else out
