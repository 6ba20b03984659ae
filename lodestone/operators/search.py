"""Search strategies over a corpus, for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.functions import understand as un
from lodestone.operators import fusion, knn, lexical
from lodestone.operators.index import Index
from lodestone.session import store

SIZE_SPLIT = 500
SEMANTIC_WEIGHT = 0.7
SCOPE = ("workspace_id", "user_id")


def scope_filter(docs: DataFrame, workspace_id=None, user_id=None, document_ids=None) -> DataFrame:
    """Ready documents, narrowed by every filter that is given."""
    df = docs.where("status = 'ready'")
    if workspace_id:
        df = df.where(F.col("workspace_id") == workspace_id)
    if user_id:
        df = df.where(F.col("user_id") == user_id)
    if document_ids:
        df = df.where(F.col("document_id").isin(list(document_ids)))
    return df


def in_scope(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Keep hits (with workspace, user and document) that their query's scope allows."""
    fields = [c for c in (*SCOPE, "document_ids") if c in queries.columns]
    if not fields:
        return hits
    asked = queries.select("query_id", *[F.col(c).alias(f"_q_{c}") for c in fields])
    test = F.lit(True)
    for c in fields:
        want = F.col(f"_q_{c}")
        if c == "document_ids":
            test = test & (want.isNull() | (F.size(want) <= 0) | F.array_contains(want, F.col("document_id")))
        else:
            test = test & (want.isNull() | (F.col(c) == want))
    return hits.join(asked, "query_id").where(test).drop(*[f"_q_{c}" for c in fields])


def _scope_columns(queries: DataFrame) -> tuple[str, ...]:
    fields = [c for c in SCOPE if c in queries.columns]
    return (*fields, "document_id") if "document_ids" in queries.columns else tuple(fields)


def embedded(queries: DataFrame, corpus: Index) -> DataFrame:
    if "vec" in queries.columns:
        return queries
    return queries.withColumn("vec", corpus.embed(F.col("text")))


def semantic(queries: DataFrame, corpus: Index, k: int, size: Column | None = None, approximate: bool = False, probes: int = 10) -> DataFrame:
    """Nearest chunks; `approximate` reads only the `probes` inverted lists nearest to a query.

    The lists hold different texts, not the scopes of their copies: queries with a scope are compared with all of it.
    """
    if approximate:
        if corpus.lists is None or size is not None:
            raise ValueError("approximate search needs an index with lists and takes all sizes")
        if not _scope_columns(queries):
            probe = lambda asked, _, n, **kw: knn.nearest_lists(asked, corpus.lists, n, probes)
            return fusion.named(knn.nearest_copies(embedded(queries, corpus), corpus.dense, corpus.copies, k, find=probe), "semantic")
    side = corpus.dense if size is None else corpus.dense.where(size)
    return fusion.named(knn.nearest_copies(embedded(queries, corpus), side, corpus.copies, k, scope=SCOPE), "semantic")


def visual(queries: DataFrame, corpus: Index, k: int) -> DataFrame:
    return fusion.named(knn.nearest_copies(embedded(queries, corpus), corpus.visual, corpus.visual_copies, k, scope=SCOPE), "visual")


def alike(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every query as (query_id, same), and one row for queries of equal text and scope, with `same` as its query_id."""
    fields = ["text", *[c for c in (*SCOPE, "document_ids") if c in queries.columns]]
    named = queries.select("query_id", *fields, F.sha2(F.to_json(F.struct(*fields)), 256).alias("same"))
    return named.select("query_id", "same"), named.drop("query_id").dropDuplicates(["same"]).withColumnRenamed("same", "query_id")


def keyword(queries: DataFrame, corpus: Index, k: int, all_terms: bool = True) -> DataFrame:
    """Best chunks by BM25 among those with all terms of a query, or with any. Equal queries and equal texts are compared once."""
    each, asked = alike(queries)
    members, fields = corpus.postings.select("chunk_id", *SCOPE, "document_id", "first"), list(_scope_columns(queries))
    lists = corpus.postings.where("terms IS NOT NULL").select("chunk_id", "dl", "terms")
    # Texts are scored once, whatever the scopes they are asked in.
    texts = asked.select(F.sha2("text", 256).alias("query_id"), "text").dropDuplicates(["query_id"]) if fields else asked
    if all_terms:
        scored = lexical.all_terms_scores(texts, lists, corpus.terms, corpus.stats, "chunk_id")
    else:
        # Lists are dealt by chunk, packed: then the pairs of queries and chunks are summed where they arise and never move.
        scored = lexical.bm25_scores(texts, lexical.unpacked(lists.repartition("chunk_id")), corpus.terms, corpus.stats, "chunk_id")
    if fields:
        homes = members.groupBy("first", *fields).agg(F.min("chunk_id").alias("chunk_id"))
        scored = scored.select(F.col("query_id").alias("_text"), F.col("chunk_id").alias("first"), "score")
        scored = scored.join(asked.select("query_id", F.sha2("text", 256).alias("_text")), "_text").drop("_text")
        scored = in_scope(scored.join(homes, "first"), asked)
    found = knn.spread_copies(lexical.top_k(scored, k), members, fields, k).select(F.col("query_id").alias("same"), "chunk_id", "score")
    return fusion.named(lexical.top_k(each.join(found, "same").select("query_id", "chunk_id", "score"), k), "keyword")


def keyword_cover(queries: DataFrame, corpus: Index, k: int) -> DataFrame:
    """Chunks that hold all terms of a query, ranked by how closely together the terms stand."""
    if corpus.places is None:
        raise ValueError("cover density needs an index with places")
    scored = lexical.cover_scores(queries, corpus.places, corpus.terms, "chunk_id", carry=_scope_columns(queries))
    return fusion.named(lexical.top_k(in_scope(scored, queries), k), "keyword")


def ident(queries: DataFrame, corpus: Index, k: int) -> DataFrame:
    scope = tuple(c for c in (*SCOPE, "document_ids") if c in queries.columns)
    return fusion.named(lexical.identifier_top(queries, corpus.anchors, k, scope), "ident")


def hybrid(queries: DataFrame, corpus: Index, k: int, semantic_weight: float | None = None) -> DataFrame:
    parts = [semantic(queries, corpus, 2 * k), keyword(queries, corpus, 2 * k), ident(queries, corpus, k)]
    if corpus.visual is not None:
        parts.append(visual(queries, corpus, 2 * k))
    lists = fusion.stack(*parts)
    if semantic_weight is None:
        weights = queries.select("query_id", un.adaptive_weight(F.col("text"), SEMANTIC_WEIGHT).alias("_w"))
        return fusion.hybrid(lists.join(weights, "query_id"), F.col("_w"), k)
    return fusion.hybrid(lists, semantic_weight, k)


def granularity_lists(queries: DataFrame, corpus: Index, k: int) -> tuple[DataFrame, DataFrame]:
    small = semantic(queries, corpus, k, F.col("token_count") < SIZE_SPLIT)
    large = semantic(queries, corpus, k, F.col("token_count") >= SIZE_SPLIT)
    return small.withColumn("list", F.lit("small")), large.withColumn("list", F.lit("large"))


def multi_granularity(queries: DataFrame, corpus: Index, k: int) -> DataFrame:
    """Small and large chunks, keywords (not for SEMANTIC queries), identifiers and images, fused."""
    lexical_side = queries.where("strategy <> 'SEMANTIC'") if "strategy" in queries.columns else queries
    parts = [*granularity_lists(queries, corpus, k), keyword(lexical_side, corpus, k), ident(queries, corpus, k)]
    if corpus.visual is not None:
        parts.append(visual(queries, corpus, k))
    return fusion.rrf(fusion.stack(*parts), k, fusion.visual_weight())


def missing(queries: DataFrame, found: DataFrame) -> DataFrame:
    return queries.join(found.select("query_id").distinct(), "query_id", "left_anti")


def _plain(ranked: DataFrame, label: str) -> DataFrame:
    return ranked.select("query_id", "chunk_id", "score", "rank", F.lit(label).alias("strategy_used"))


def search(queries: DataFrame, corpus: Index, k: int, use_multi_granularity: bool = True) -> DataFrame:
    """Route every query by its `strategy`: (query_id, chunk_id, score, rank, strategy_used).

    Keyword queries without a hit fall back to semantic search, semantic ones to hybrid.
    The scope of a query holds in every fallback.
    """
    if use_multi_granularity:
        return multi_granularity(queries, corpus, k).join(
            queries.select("query_id", F.col("strategy").alias("strategy_used")), "query_id"
        )
    by = {s: queries.where(F.col("strategy") == s) for s in ("SEMANTIC", "KEYWORD")}
    rest = queries.where(~F.col("strategy").isin("SEMANTIC", "KEYWORD"))
    words = _plain(keyword(by["KEYWORD"], corpus, k), "KEYWORD")
    unmatched = missing(by["KEYWORD"], words)
    meaning = _plain(semantic(by["SEMANTIC"], corpus, k), "SEMANTIC")
    empty = missing(by["SEMANTIC"], meaning)
    second = _plain(semantic(unmatched, corpus, k), "SEMANTIC")
    both = _plain(hybrid(rest.unionByName(empty), corpus, k), "HYBRID")
    return words.unionByName(meaning).unionByName(second).unionByName(both)


def top_scores(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("query_id").agg(F.max("score").alias("top"))


def retry_low(queries: DataFrame, ranked: DataFrame, corpus: Index, k: int, bar: float = 0.5) -> DataFrame:
    """Queries other than HYBRID whose best score is low also run HYBRID; the better one stays."""
    weak = top_scores(ranked).where(F.col("top") < bar).join(
        queries.where("strategy <> 'HYBRID'").select("query_id"), "query_id", "left_semi"
    )
    again = _plain(hybrid(queries.join(weak, "query_id", "left_semi"), corpus, k), "HYBRID")
    better = top_scores(again).withColumnRenamed("top", "new").join(weak, "query_id").where("new > top")
    kept = ranked.join(better, "query_id", "left_anti")
    return kept.unionByName(again.join(better.select("query_id"), "query_id"))


def confidence(top: Column) -> Column:
    """The cuts of the confidence classes."""
    return F.when(top >= 0.7, "high").when(top >= 0.5, "low").otherwise("very_low")


def _with_scope(asked: DataFrame, queries: DataFrame) -> DataFrame:
    """Give derived queries the scope of the query they belong to."""
    fields = [c for c in (*SCOPE, "document_ids") if c in queries.columns]
    return asked.drop(*fields).join(queries.select("query_id", *fields), "query_id") if fields else asked


def _derived(asked: DataFrame) -> DataFrame:
    """An id of its own for every (query_id, n), and the query it belongs to as `origin`."""
    return asked.withColumn("origin", F.col("query_id")).withColumn("query_id", F.concat_ws("#", "query_id", "n")).drop("n")


def _with_origin(found: DataFrame, asked: DataFrame) -> DataFrame:
    return found.join(asked.select("query_id", "origin"), "query_id")


def hyde_merge(queries: DataFrame, ranked: DataFrame, hypothetical: DataFrame, corpus: Index, k: int) -> DataFrame:
    """For very low confidence, fuse with searches for hypothetical answers, within the query's scope.

    `hypothetical` holds (query_id, n, text) and optionally vectors; texts that fail the
    gate are ignored. The merge is used where it improves the best score. What is read in many places is written once: the
    first result, the texts that are searched for, and what they find.
    """
    ranked = store(ranked, "ranked")
    weak = top_scores(ranked).where(confidence(F.col("top")) == "very_low")
    usable = hypothetical.where(un.hyde_usable(F.col("text"))).join(weak, "query_id", "left_semi")
    asked = store(_derived(_with_scope(embedded(usable, corpus).select("query_id", "n", "vec"), queries)), "asked")
    found = store(_with_origin(knn.nearest_copies(asked, corpus.dense, corpus.copies, k, scope=SCOPE), asked), "found")
    lists = ranked.select("query_id", F.lit("q").alias("list"), "chunk_id", "score", "rank").unionByName(
        found.select(F.col("origin").alias("query_id"), F.col("query_id").alias("list"), "chunk_id", "score", "rank")
    )
    merged = fusion.rrf(lists.join(found.select(F.col("origin").alias("query_id")).distinct(), "query_id", "left_semi"))
    better = top_scores(merged).withColumnRenamed("top", "new").join(weak, "query_id").where("new > top")
    return ranked.join(better, "query_id", "left_anti").unionByName(
        _plain(merged, "HYDE").join(better.select("query_id"), "query_id").select(ranked.columns)
    )


def multi_query_merge(
    queries: DataFrame, ranked: DataFrame, variations: DataFrame, corpus: Index, k: int, use_multi_granularity: bool = True
) -> DataFrame:
    """For low confidence, fuse with HYBRID results of the query's variations (query_id, n, text), within its scope.

    As in `hyde_merge`, the first result, the variations and what they find are written once.
    """
    ranked = store(ranked, "ranked")
    weak = top_scores(ranked).where(confidence(F.col("top")) == "low")
    asked = store(_derived(_with_scope(variations.join(weak, "query_id", "left_semi").select("query_id", "n", "text"), queries)), "asked")
    found = store(_with_origin((multi_granularity if use_multi_granularity else hybrid)(asked, corpus, k), asked), "found")
    lists = ranked.select("query_id", "chunk_id", "score", "rank").unionByName(
        found.select(F.col("origin").alias("query_id"), "chunk_id", "score", "rank")
    )
    hit = found.select(F.col("origin").alias("query_id")).distinct()
    merged = _plain(fusion.rrf(lists.join(hit, "query_id", "left_semi")), "MULTI_QUERY")
    return ranked.join(hit, "query_id", "left_anti").unionByName(merged.select(ranked.columns))


def overlap_score(query: Column, passage: Column) -> Column:
    """Default rerank model: share of the query's distinct tokens found in the passage."""
    from lodestone.functions import text as tx

    asked = F.array_distinct(tx.tokens(query))
    return F.size(F.array_intersect(asked, tx.tokens(passage))) / F.greatest(F.size(asked), F.lit(1))


def rerank(candidates: DataFrame, k: int, blend: float = 0.3, score_pair=overlap_score, passage_chars: int | None = None) -> DataFrame:
    """Blend the model's score with the retrieval score, both scaled to [0, 1] within a query.

    Rows (query_id, text, chunk_id, content, caption, score, rank). Queries with no more than
    k candidates keep their order. `score_pair` is a model slot: it maps query and passage
    columns to a score column; it sees whole passages unless `passage_chars` cuts them.
    """
    passage = F.btrim(F.concat_ws(" ", F.coalesce("caption", F.lit("")), "content"))
    if passage_chars is not None:
        passage = F.substring(passage, 1, passage_chars)
    per_query = W.partitionBy("query_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(per_query), F.max(c).over(per_query)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.5)

    df = candidates.withColumn("_model", score_pair(F.col("text"), passage)).withColumn("_n", F.count("*").over(per_query))
    df = df.withColumn("_mix", F.round((1 - blend) * scaled("_model") + blend * scaled("score"), 6))
    df = df.withColumn("score", F.when(F.col("_n") > k, F.col("_mix")).otherwise(F.col("score")))
    order = per_query.orderBy(
        F.desc(F.when(F.col("_n") > k, F.col("_mix")).otherwise(-F.col("rank").cast("double"))), "chunk_id"
    )
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_model", "_n", "_mix")
