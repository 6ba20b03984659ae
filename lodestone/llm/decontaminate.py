"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of consecutive words. A text contains a window only if it contains each of its words, so
one word per window is enough to find candidates: the rarest by its count over all texts (a containment of 1.0 needs a
prefix of one token in rarity order). Texts and windows meet by equality on that word; the word's position in the
window fixes where the window would start, which the length bounds check before the words themselves are compared.

Texts are keyed by digest while they are searched, so copies are verified once and repeated ids do no harm. What the
planner may broadcast depends on the size of the items alone, by its own size check.

Defined cases: null text has no words; a text or item without words hits nothing; an item shorter than a window is one
window of all its words; items with a null id are ignored, items that share an id count as one; repeated rows each get
a row; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestone.llm.common import lower_ascii, numbered, read_table, store

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: digits, ASCII letters and all characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """wid, item, win: the windows of every item; wid is the digest of the window's words."""
    own = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    cut = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.least(F.lit(window), F.size("w"))))).alias("win"))
    return cut.select(F.md5(F.array_join("win", " ").cast("binary")).alias("wid"), "item", "win")


def keyed_windows(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """key, at, wid, win: each different window under its rarest word and that word's offset. Windows with a word that no text has go."""
    distinct = windows.groupBy("wid").agg(F.first("win").alias("win"))
    tokens = store(distinct.select(F.explode("win").alias("token")).distinct(), "tokens")
    counts = store(texts.select(F.explode(words_of(F.col("text"))).alias("token")).join(tokens, "token").groupBy("token").agg(F.count("*").alias("n")), "counts")
    ordered = distinct.select("wid", F.size("win").alias("size"), F.posexplode("win").alias("at", "token")).join(counts, "token")
    best = ordered.groupBy("wid").agg(F.min(F.struct("n", "token", "at")).alias("rarest"), F.count("*").alias("known"), F.first("size").alias("size"))
    best = best.filter("known = size").select("wid", F.col("rarest.token").alias("key"), F.col("rarest.at").alias("at"))
    return best.join(distinct, "wid").select("key", "at", "wid", "win")


def occurrences(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """digest, start, size, wid: where windows occur in texts (digest, text). Starts count from 0.

    A text's words first pass the set of keys, which is much smaller than the windows; only what passes meets them.
    """
    keys = store(keyed.select("key").distinct(), "keys")
    each = texts.select("digest", words_of(F.col("text")).alias("w")).select("digest", F.size("w").alias("n"), F.posexplode("w").alias("pos", "key"))
    near = each.join(keys, "key", "left_semi").join(keyed.select("key", "at", "wid", F.size("win").alias("size")), "key").withColumn("start", F.col("pos") - F.col("at"))
    near = store(near.filter("start >= 0 AND start + size <= n").select("digest", "start", "wid").distinct(), "candidates")
    listed = near.join(keyed.select("wid", "win"), "wid").groupBy("digest").agg(F.collect_list(F.struct("start", "wid", "win")).alias("near"))
    met = listed.join(texts, "digest").groupBy("digest").agg(F.first("text").alias("text"), F.first("near").alias("near"))
    # the words are bound once for each text; as a plain column they would be split anew for each candidate
    found = F.transform(F.array(words_of(F.col("text"))), lambda w: F.filter("near", lambda c: F.slice(w, c["start"] + 1, F.size(c["win"])) == c["win"]))[0]
    return met.select("digest", F.explode(found).alias("c")).select("digest", "c.start", F.size("c.win").alias("size"), "c.wid")


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, name: str = "_hits") -> DataFrame:
    """`docs` with a struct `name` as last column: n_words, n_hit (words inside windows of items), items (their ids as sorted strings)."""
    digest = F.md5(F.col(text_col).cast("binary"))
    texts = docs.select(digest.alias("digest"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    windows = store(item_windows(items, item_id, item_text, window), "windows")
    found = store(occurrences(texts, store(keyed_windows(windows, texts), "keyed")), "found")
    before = Window.partitionBy("digest").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    reached = found.select("digest", "start", "size").distinct().withColumn("upto", F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = reached.groupBy("digest").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "upto"))).cast("long").alias("n_hit"))
    named = found.select("digest", "wid").distinct().join(windows.select("wid", "item").distinct(), "wid")
    listed = named.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = store(covered.join(listed, "digest").select(F.col("digest").alias("_digest"), F.col("n_hit").alias("_n_hit"), F.col("items").alias("_items")), "hits")
    text = F.col(f"c{docs.columns.index(text_col)}")
    rows = numbered(docs).withColumns({"_digest": F.md5(text.cast("binary")), "_n_words": F.coalesce(F.size(words_of(text)), F.lit(0)).cast("long")})
    struct = F.struct(
        F.col("_n_words").alias("n_words"), F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items")
    )
    return rows.join(hits, "_digest", "left").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), struct.alias(name))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", F.col("_hits.n_words").alias("n_words"), F.col("_hits.n_hit").alias("n_hit"), F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"), (F.col("_hits.n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS s FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM i)),
z AS (SELECT DISTINCT size FROM v),
x AS (SELECT n, size, k, array_to_string(w[k : k + size - 1], ' ') AS s FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, z WHERE len(w) >= size)),
h AS (SELECT x.n, x.k, x.size, v.item_id FROM x JOIN v ON x.s = v.s AND x.size = v.size),
p AS (SELECT n, count(DISTINCT pos) AS n_hit FROM (SELECT n, unnest(range(k, k + size)) AS pos FROM h) GROUP BY n),
q AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM h) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (n) LEFT JOIN q USING (n)
"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {"op5_decontaminate": SQL}
