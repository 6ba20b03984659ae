"""Keyword search: postings, corpus statistics, BM25, all-terms match, identifiers."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.functions import text as tx
from lodestone.functions.counts import anchor_runs, term_counts
from lodestone.operators.sizes import broadcast_if_small, is_small

K1, B = 1.2, 0.75
# Identifiers that are looked up literally.
IDENTIFIER = r"(?i)\b(?:SKU-[A-Z0-9-]+|FIG-[A-Z0-9-]+|site\s+[0-9]+)\b"
_PREFIX = 64


def term_lists(docs: DataFrame, key: str, text: Column, *carry: str) -> DataFrame:
    """One row per document: (key, carry.., dl, terms), its length and an array of (token, tf). No shuffle."""
    return docs.select(key, *carry, term_counts(text).alias("_c")).select(key, *carry, "_c.dl", "_c.terms")


def unpacked(lists: DataFrame) -> DataFrame:
    """Postings of term lists."""
    return lists.select(*[c for c in lists.columns if c != "terms"], F.inline("terms"))


def postings(docs: DataFrame, key: str, text: Column, *carry: str) -> DataFrame:
    """One row per document and distinct token: (key, carry.., dl, token, tf)."""
    return unpacked(term_lists(docs, key, text, *carry))


def stats_of(lists: DataFrame) -> DataFrame:
    """One row: number of documents and mean length in tokens."""
    return lists.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """`stats_of` a table of texts."""
    return stats_of(docs.select(term_counts(text).alias("_c")).select("_c.dl"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf, terms): repeated query words count as often as they occur."""
    counted = queries.select("query_id", term_counts(F.col("text")).alias("c"))
    return counted.select("query_id", F.size("c.terms").alias("terms"), F.inline("c.terms")).withColumnRenamed("tf", "qtf")


def term_score(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    """Okapi weight of one term in one document."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.greatest(dl, F.lit(1)) / avgdl))


def bm25_scores(
    queries: DataFrame,
    posts: DataFrame,
    frequency: DataFrame,
    stats: DataFrame,
    key: str,
    all_terms: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Score of every document that shares a term with a query: (query_id, key, carry.., score).

    Query terms, weighted by document frequency, are joined to the postings first, so only
    matching postings are shuffled, and those are summed before they are.

    With `all_terms` only documents that hold every term of the query are returned. Such a
    document holds the query's rarest term, so the few postings of that term name all
    candidates, and only these are looked up for the other terms.
    """
    terms = query_terms(queries)
    # The weighted terms and the rarest ones are no more than the query terms, so only those are measured.
    sized = F.broadcast if is_small(terms) else (lambda df: df)
    weighted = (
        frequency.join(sized(terms), "token")
        .withColumn("n", stats.select("n").scalar())
        .withColumn("avgdl", stats.select("avgdl").scalar())
    )
    part = term_score(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")) * F.col("qtf")
    hits = posts.select(key, *carry, "dl", "token", "tf")
    if all_terms:
        known = weighted.groupBy("query_id").agg(
            F.min_by("token", F.struct("df", "token")).alias("token"), F.count("*").alias("_m"), F.first("terms").alias("_t")
        )
        rare = known.where("_m = _t").select("query_id", "token")
        candidates = posts.select(key, "token").join(sized(rare), "token").select("query_id", key)
        hits = hits.join(broadcast_if_small(candidates.join(weighted, "query_id")), [key, "token"])
    else:
        hits = hits.join(sized(weighted), "token")
    scored = hits.groupBy("query_id", key, *carry).agg(
        F.sum(part).alias("score"), F.count("*").alias("matched"), F.first("terms").alias("terms")
    )
    if all_terms:
        scored = scored.where("matched = terms")
    return scored.select("query_id", key, *carry, F.round("score", 6).alias("score"))


def all_terms_scores(queries: DataFrame, lists: DataFrame, frequency: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Score of every document that holds all terms of a query: (query_id, key, score). `lists` are term lists (key, dl, terms).

    The query's rarest term names its candidates where the list lies, and the list itself says whether it holds the others; so no
    postings are moved, however many candidates there are. Only if the query terms are too many to be sent to the lists,
    candidates are found by a join on the term and then meet their lists, once for each.
    """
    terms = query_terms(queries)
    small = is_small(terms)
    sized = F.broadcast if small else (lambda df: df)
    weighted = (
        frequency.join(sized(terms), "token")
        .withColumn("n", stats.select("n").scalar())
        .withColumn("avgdl", stats.select("avgdl").scalar())
    )
    known = weighted.groupBy("query_id").agg(
        F.min_by("token", F.struct("df", "token")).alias("token"), F.collect_list("token").alias("all"), F.first("terms").alias("_t")
    )
    rare = known.where(F.size("all") == F.col("_t")).select("query_id", "token", "all")
    if small:
        met = lists.select(key, "dl", "terms", F.inline("terms")).drop("tf").join(F.broadcast(rare), "token")
    else:
        met = lists.select(key, F.inline("terms")).join(rare, "token").select("query_id", "all", key).join(lists.select(key, "dl", "terms"), key)
    held = F.size(F.array_intersect("terms.token", "all"))
    hits = met.where(held == F.size("all")).select("query_id", key, "dl", F.inline("terms")).join(sized(weighted), ["query_id", "token"])
    part = term_score(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")) * F.col("qtf")
    return hits.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: Column, k: int) -> DataFrame:
    """Best k documents per query straight from a table of texts."""
    posts = postings(docs, key, text)
    vocabulary = query_terms(queries).select("token").distinct()
    frequency = document_frequency(posts.join(vocabulary, "token", "left_semi"))
    return top_k(bm25_scores(queries, posts, frequency, corpus_stats(docs, text), key), k, key)


def positional_postings(docs: DataFrame, key: str, text: Column, *carry: str) -> DataFrame:
    """One row per document and distinct token: (key, carry.., token, places), places in order from 0. No shuffle."""

    def gathered(found: Column) -> Column:
        starts = tx.runs(F.size(found), lambda i: (i == 0) | (found[i]["token"] != found[F.greatest(i - 1, F.lit(0))]["token"]))
        return tx.let(
            starts,
            lambda at: F.transform(
                at,
                lambda i, j: F.struct(
                    found[i]["token"].alias("token"),
                    F.transform(F.slice(found, i + 1, F.coalesce(F.get(at, j + 1), F.size(found)) - i), lambda s: s["place"]).alias("places"),
                ),
            ),
        )

    numbered = F.transform(tx.tokens(text), lambda token, i: F.struct(token.alias("token"), i.alias("place")))
    return docs.select(key, *carry, F.inline(tx.let(F.sort_array(numbered), gathered)))


def cover_density(hits: Column, terms: Column) -> Column:
    """Sum over the minimal covers of 0.1 / (1 + other words inside), at most 1. `hits` are (place, term) in order.

    A cover is a stretch that holds all terms and no shorter stretch that does. One walk with a state of fixed size:
    the last hit of every term. A hit ends a minimal cover when the earliest of those has moved on.
    """

    def step(a: Column, hit: Column) -> Column:
        last = F.transform(a["last"], lambda x, t: F.when(t == hit["term"], a["i"]).otherwise(x))
        return F.struct((a["i"] + 1).alias("i"), last.alias("last"), a["start"].alias("start"), a["sum"].alias("sum"), F.array_min(last).alias("low"), hit["place"].alias("end"))

    def counted(found: Column, a: Column) -> Column:
        noise = a["end"] - F.get(found, F.greatest(a["low"], F.lit(0)))["place"] + 1 - (a["i"] - a["low"])
        more = F.when(a["low"] > a["start"], F.lit(0.1) / (1 + noise)).otherwise(0.0)
        return F.struct(a["i"].alias("i"), a["last"].alias("last"), F.greatest(a["start"], a["low"]).alias("start"), (a["sum"] + more).alias("sum"))

    none = F.lit(-1)
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(none, terms).alias("last"), none.alias("start"), F.lit(0.0).alias("sum"))
    walk = lambda found: F.aggregate(
        found, start, lambda a, hit: tx.let(step(a, hit), lambda b: counted(found, b)), lambda a: F.least(a["sum"], F.lit(1.0))
    )
    return tx.let(hits, walk)


def cover_scores(queries: DataFrame, places: DataFrame, frequency: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cover density of every document that holds all terms of a query: (query_id, key, carry.., score).

    The postings of a query's rarest term name its candidates, and only these are looked up for the other terms.
    """
    terms = query_terms(queries)
    order = W.partitionBy("query_id").orderBy("token")
    terms = terms.withColumn("term", F.row_number().over(order) - 1).select("query_id", "token", "terms", "term")
    known = frequency.join(broadcast_if_small(terms), "token")
    rare = known.groupBy("query_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.count("*").alias("m"), F.first("terms").alias("terms"))
    candidates = places.select(key, "token").join(rare.where("m = terms"), "token").select("query_id", key)
    wanted = candidates.join(known.select("query_id", "token", "terms", "term"), "query_id")
    hits = places.select(key, *carry, "token", "places").join(wanted, [key, "token"])
    gathered = hits.groupBy("query_id", key, *carry).agg(
        F.first("terms").alias("terms"), F.count("*").alias("matched"),
        F.collect_list(F.transform("places", lambda p: F.struct(p.alias("place"), F.col("term").alias("term")))).alias("found"),
    )
    score = cover_density(F.sort_array(F.flatten("found")), F.col("terms"))
    return gathered.where("matched = terms").select("query_id", key, *carry, F.round(score, 6).alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "chunk_id", score: str = "score") -> DataFrame:
    """Best k per query with ranks from 1; ties go to the smaller key.

    The limit is pushed in front of the shuffle, so a query with many hits stays cheap.
    """
    order = W.partitionBy("query_id").orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def identifiers(text: Column, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return found if limit is None else F.slice(found, 1, limit)


def anchors(chunks: DataFrame, *carry: str) -> DataFrame:
    """Places where an identifier can begin: (chunk_id, carry.., run).

    A run is the longest stretch an identifier starting there could cover, so an identifier
    occurs at that place exactly when the run starts with it.
    """

    text = lambda c: F.coalesce(c, F.lit(""))
    found = F.array_distinct(F.concat(anchor_runs(text("content")), anchor_runs(text("caption"))))
    return chunks.select("chunk_id", *carry, F.explode(found).alias("run"))


def _offered(wanted: DataFrame, places: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(chunk_id, carry.., run, key): prefixes of the runs in the lengths of the wanted keys."""
    lengths = wanted.agg(F.collect_set(F.length("key")).alias("l")).scalar()  # at most as many as a prefix is long
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("run")), lambda n: F.substring(F.col("run"), F.lit(1), n))
    return places.withColumn("lengths", lengths).select("chunk_id", *carry, "run", F.explode(prefixes).alias("key"))


def identifier_hits(queries: DataFrame, places: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that contain one of the query's identifiers, case-insensitive.

    An equality join instead of a contains join: the chunk side offers the prefixes of its
    runs in the lengths that are asked for, up to a fixed one; a longer identifier joins on
    that prefix and is then compared in full.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(identifiers(F.lower("text")))).alias("ident"))
    wanted = wanted.withColumn("key", F.substring("ident", 1, _PREFIX))
    hits = _offered(wanted, places, carry).join(wanted, "key").where(F.col("run").startswith(F.col("ident")))
    return hits.select("query_id", "chunk_id", *carry).distinct().withColumn("score", F.lit(1.0))


def identifier_lists(asked: DataFrame, places: DataFrame, k: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """(asked, chunk_id, score): the first k chunks of every different identifier and scope.

    `asked` is the distinct struct of an identifier and of the scope columns of its queries. Every combination of given
    scope columns is an equality join, so that a place meets an identifier only in the scopes it belongs to.
    """
    wanted = asked.select("asked", F.col("asked.ident").alias("ident"), F.substring("asked.ident", 1, _PREFIX).alias("key"))
    fields = ["document_id" if c == "document_ids" else c for c in scope]
    offered, parts = _offered(wanted, places, tuple(fields)), []
    for given in product([True, False], repeat=len(scope)):
        part, on = wanted, ["key"]
        for use, c, field in zip(given, scope, fields):
            value = F.col(f"asked.{c}")
            part = part.where(value.isNotNull() if use else value.isNull())
            if use:
                part = part.withColumn(field, F.explode(value) if c == "document_ids" else value)
                on.append(field)
        parts.append(offered.join(part, on).where(F.col("run").startswith(F.col("ident"))).select("asked", "chunk_id"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.distinct().select(F.col("asked").alias("query_id"), "chunk_id", F.lit(1.0).alias("score"))
    return top_k(found, k).select(F.col("query_id").alias("asked"), "chunk_id", "score")


def identifier_top(queries: DataFrame, places: DataFrame, k: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """Best k chunks of every query by its identifiers, within its scope: (query_id, chunk_id, score, rank).

    All hits score alike, so a query's best k are among the first k of each of its identifiers. These are found once for
    every different identifier and scope: an identifier that many queries ask for and many chunks hold makes no pairs.
    """
    kept = [F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c))).alias(c) if c == "document_ids" else F.col(c) for c in scope]
    found = queries.select("query_id", F.explode(F.array_distinct(identifiers(F.lower("text")))).alias("ident"), *kept)
    found = found.select("query_id", F.struct("ident", *scope).alias("asked"))
    lists = identifier_lists(found.select("asked").distinct(), places, k, scope)
    return top_k(found.join(lists, "asked").select("query_id", "chunk_id", "score").distinct(), k)
