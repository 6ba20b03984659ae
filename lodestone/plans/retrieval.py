"""Vector, keyword and fused search queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodestone.functions import understand as un
from lodestone.functions import vectors as vec
from lodestone.operators import fusion, knn, lexical, search
from lodestone.plans.registry import ORACLES, query, view
from lodestone.plans.views import Views, label_vectors

K = 10


def corpus(t: Views, images: bool = True):
    return t.index if images else t.index.without_images()


def routed(t: Views):
    return t.queries.withColumn("strategy", un.route(F.col("text")))


def label_side(t: Views):
    return t.table("embeddings").select("vec_id", F.col("embedding").alias("vec"))


# --- vectors -----------------------------------------------------------------------------

view("v_means", r"""
SELECT label AS query_id, i, avg(x) AS x FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""")
view("v_comp", r"""
SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS i FROM embeddings""")
view("v_label_cos", r"""
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(s / (qn * cn), 6) AS score
FROM (SELECT query_id, vec_id, sum(x * y) AS s FROM v_means JOIN v_comp USING (i) GROUP BY ALL)
JOIN (SELECT query_id, sqrt(sum(x * x)) AS qn FROM v_means GROUP BY ALL) USING (query_id)
JOIN (SELECT vec_id, sqrt(sum(y * y)) AS cn FROM v_comp GROUP BY ALL) USING (vec_id)""")


@query("cosine", r"""
SELECT e.vec_id, c.score FROM v_label_cos c JOIN embeddings e ON e.vec_id = c.vec_id AND e.label = c.query_id""")
def cosine(t: Views):
    """Similarity of every vector to the mean of its label."""
    means = label_vectors(t).withColumnRenamed("vec", "mean")
    e = t.table("embeddings").select("vec_id", F.col("label").cast("bigint").alias("query_id"), "embedding")
    return e.join(means, "query_id").select(
        "vec_id", F.round(vec.cosine(F.col("embedding"), F.col("mean")), 6).alias("score")
    )


@query("cosine_topk", r"""
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
FROM v_label_cos QUALIFY rank <= 10""")
def cosine_topk(t: Views):
    return knn.nearest(label_vectors(t), label_side(t), K, key="vec_id")


#: Share of the lists that a query probes in `ivf_topk`.
PROBED = 0.32


def probes_of(lists: knn.Lists, share: float) -> int:
    return max(1, math.ceil(share * lists.centroids.count()))


@query("ivf_topk")
def ivf_topk(t: Views):
    """Approximate neighbours from the written lists; recall against the exact ones and the rows read are measured in the tests."""
    return knn.nearest_lists(label_vectors(t), t.vector_lists, K, probes_of(t.vector_lists, PROBED))


@query("ivf_all_lists", ORACLES["cosine_topk"])
def ivf_all_lists(t: Views):
    """With all lists probed the index gives the exact neighbours."""
    return knn.nearest_lists(label_vectors(t), t.vector_lists, K, probes_of(t.vector_lists, 1))


@query("embed_dense", f"""
SELECT chunk_id, CAST({vec.DENSE_DIM} AS INT) AS dim, round(sqrt(sum(w * w)), 6) AS norm FROM v_dense JOIN v_corpus USING (chunk_id)
WHERE chunk_type = 'text' GROUP BY chunk_id""")
def embed_dense(t: Views):
    """Embedding slot over distinct chunk texts: equal texts are embedded once, vectors follow the hash."""
    from lodestone.operators.slots import embed_once

    chunks = t.index.chunks.where("selected and chunk_type = 'text'").select("chunk_id", "content", "content_hash")
    done = embed_once(chunks, "content", "content_hash", vec.lexical_counts)
    return done.select("chunk_id", F.size("vec").alias("dim"), F.round(vec.norm(F.col("vec")), 6).alias("norm"))


# --- single lists ------------------------------------------------------------------------

view("v_qterms", r"""
SELECT *, count(*) OVER (PARTITION BY query_id) AS terms FROM (SELECT query_id, token, count(*) AS qtf
FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM v_queries) GROUP BY ALL)""")
view("v_dtok", r"""
SELECT document_id, len(toks) AS dl, unnest(CASE WHEN len(toks) = 0 THEN [NULL] ELSE toks END) AS token
FROM (SELECT document_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS toks FROM v_docs)""")
view("v_ctok", r"""
SELECT chunk_id, workspace_id, user_id, len(toks) AS dl, unnest(CASE WHEN len(toks) = 0 THEN [NULL] ELSE toks END) AS token
FROM (SELECT chunk_id, workspace_id, user_id,
        regexp_extract_all(lower(concat_ws(' ', content, caption)), '[a-z0-9]+') AS toks FROM v_corpus)""")


def bm25_sql(tokens: str, key: str, all_terms: bool) -> str:
    having = "HAVING count(*) = any_value(terms)" if all_terms else ""
    return f"""
SELECT query_id, {key}, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2)
         / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 6) AS score
FROM (SELECT {key}, token, dl, count(*) AS tf FROM {tokens} WHERE token IS NOT NULL GROUP BY ALL) p
JOIN v_qterms USING (token)
JOIN (SELECT token, count(DISTINCT {key}) AS df FROM {tokens} GROUP BY ALL) USING (token)
CROSS JOIN (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT {key}, any_value(dl) AS dl FROM {tokens} GROUP BY ALL))
GROUP BY query_id, {key} {having}"""


view("v_bm25", bm25_sql("v_dtok", "document_id", False))
view("v_kw", bm25_sql("v_ctok", "chunk_id", True))


def top_sql(source: str, k: int, key: str = "chunk_id", name: str | None = None) -> str:
    label = f"'{name}' AS list, " if name else ""
    return (
        f"SELECT query_id, {label}{key}, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INT)"
        f" AS rank FROM {source} QUALIFY rank <= {k}"
    )


view("v_sem", top_sql("v_cos", K, name="semantic"))
view("v_sem2", top_sql("v_cos", 2 * K, name="semantic"))
view("v_kwl", top_sql("v_kw", K, name="keyword"))
view("v_kwl2", top_sql("v_kw", 2 * K, name="keyword"))
view("v_vis", top_sql("v_vcos", K, name="visual"))
view("v_vis2", top_sql("v_vcos", 2 * K, name="visual"))
view("v_small", top_sql("v_cos JOIN v_corpus USING (chunk_id) WHERE token_count < 500", K, name="small"))
view("v_large", top_sql("v_cos JOIN v_corpus USING (chunk_id) WHERE token_count >= 500", K, name="large"))


@query("bm25_stats", r"""
SELECT token, count(DISTINCT document_id) AS df, count(*) AS cf,
  round(ln(1 + ((SELECT count(*) FROM v_docs) - count(DISTINCT document_id) + 0.5) / (count(DISTINCT document_id) + 0.5)), 6) AS idf,
  (SELECT round(avg(dl), 6) FROM (SELECT document_id, any_value(dl) AS dl FROM v_dtok GROUP BY ALL)) AS avgdl
FROM v_dtok WHERE token IS NOT NULL GROUP BY token""")
def bm25_stats(t: Views):
    posts = lexical.postings(t.docs, "document_id", F.col("content"))
    stats = lexical.corpus_stats(t.docs, F.col("content"))
    counted = posts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    idf = F.log(1 + (stats.select("n").scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counted.select("token", "df", "cf", F.round(idf, 6).alias("idf"), F.round(stats.select("avgdl").scalar(), 6).alias("avgdl"))


@query("bm25", top_sql("v_bm25", K, "document_id"))
def bm25(t: Views):
    return lexical.bm25(t.queries, t.docs, "document_id", F.col("content"), K)


@query("semantic_search", "SELECT query_id, chunk_id, score, rank FROM v_sem")
def semantic_search(t: Views):
    return search.semantic(t.queries, corpus(t), K).drop("list")


@query("semantic_approximate")
def semantic_approximate(t: Views):
    """Chunks nearest to each query, from a third of the inverted lists of the index."""
    ix = t.index_with_lists
    return search.semantic(t.queries, ix, K, approximate=True, probes=probes_of(ix.lists, PROBED)).drop("list")


@query("semantic_all_lists", "SELECT query_id, chunk_id, score, rank FROM v_sem")
def semantic_all_lists(t: Views):
    ix = t.index_with_lists
    return search.semantic(t.queries, ix, K, approximate=True, probes=probes_of(ix.lists, 1)).drop("list")


view("v_scoped", r"""
SELECT query_id, CASE WHEN query_id % 3 > 0 THEN 'src' || (query_id % 20) END AS ws,
       CASE WHEN query_id % 3 > 1 THEN 'u' || (query_id % 7) END AS usr FROM v_queries""")
view("v_scoped_cos", r"""
SELECT c.query_id, c.chunk_id, c.score FROM v_cos c JOIN v_scoped s USING (query_id) JOIN v_corpus k USING (chunk_id)
WHERE (s.ws IS NULL OR s.ws = k.workspace_id) AND (s.usr IS NULL OR s.usr = k.user_id)""")


def scoped_queries(t: Views):
    """Queries with a workspace and a user of their own."""
    return t.queries.withColumn(
        "workspace_id", F.when(F.col("query_id") % 3 > 0, F.concat(F.lit("src"), F.col("query_id") % 20))
    ).withColumn("user_id", F.when(F.col("query_id") % 3 > 1, F.concat(F.lit("u"), F.col("query_id") % 7)))


@query("semantic_scoped", top_sql("v_scoped_cos", K))
def semantic_scoped(t: Views):
    return search.semantic(scoped_queries(t), corpus(t), K).drop("list")


@query("keyword_search", "SELECT query_id, chunk_id, score, rank FROM v_kwl")
def keyword_search(t: Views):
    return search.keyword(t.queries, corpus(t), K).drop("list")


view("v_short", "SELECT query_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS text FROM v_queries")
view("v_short_terms", r"""
SELECT *, count(*) OVER (PARTITION BY query_id) AS terms FROM (SELECT DISTINCT query_id, token
FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM v_short))""")
# Covers by their ends: of the stretches with one start the shortest is minimal.
view("v_cover_hits", r"""
SELECT query_id, chunk_id, place, term, terms FROM (
  SELECT chunk_id, unnest(toks) AS token, unnest(range(len(toks))) AS place FROM (
    SELECT chunk_id, regexp_extract_all(lower(concat_ws(' ', content, caption)), '[a-z0-9]+') AS toks FROM v_corpus))
JOIN (SELECT query_id, token, token AS term, terms FROM v_short_terms) USING (token)""")
view("v_cover_full", r"""
SELECT query_id, chunk_id FROM v_cover_hits GROUP BY query_id, chunk_id HAVING count(DISTINCT term) = any_value(terms)""")
view("v_covers", r"""
SELECT query_id, chunk_id, start, min(stop) AS stop FROM (
  SELECT query_id, chunk_id, stop, min(last) AS start FROM (
    SELECT r.query_id, r.chunk_id, r.terms, r.place AS stop, l.term, max(l.place) AS last
    FROM v_cover_hits r JOIN v_cover_hits l ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id AND l.place <= r.place
    SEMI JOIN v_cover_full f ON f.query_id = r.query_id AND f.chunk_id = r.chunk_id GROUP BY ALL)
  GROUP BY query_id, chunk_id, terms, stop HAVING count(*) = terms)
GROUP BY ALL""")
view("v_cover", r"""
SELECT query_id, chunk_id, round(least(1.0, sum(0.1 / (1 + noise))), 6) AS score FROM (
  SELECT c.query_id, c.chunk_id, c.start, stop - start + 1 - count(*) AS noise FROM v_covers c
  JOIN v_cover_hits h ON h.query_id = c.query_id AND h.chunk_id = c.chunk_id AND h.place BETWEEN start AND stop GROUP BY c.query_id, c.chunk_id, c.start, c.stop)
GROUP BY ALL""")


@query("keyword_cover", top_sql("v_cover", K))
def keyword_cover(t: Views):
    """Chunks that hold the first three words of each query, best the ones where they stand closest together."""
    short = t.queries.withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, 3), " "))
    return search.keyword_cover(short, t.index_with_places, K).drop("list")


@query("visual_search", "SELECT query_id, chunk_id, score, rank FROM v_vis")
def visual_search(t: Views):
    return search.visual(t.queries, corpus(t), K).drop("list")


@query("naive", top_sql("v_cos", 2))
def naive(t: Views):
    return search.semantic(t.queries, corpus(t), 2).drop("list")


view("v_catalog", r"""
SELECT 'part-' || p_partkey AS chunk_id, p_name || ' (SKU-' || p_brand[7:] || '-' || p_partkey || ') ' || p_type AS content,
       CASE WHEN p_size % 2 = 0 THEN 'Stored at site ' || p_size END AS caption FROM part""")
view("v_lookups", r"""
SELECT s_suppkey AS query_id, 'Where are SKU-' || s_nationkey || '-' || s_suppkey || ' and site ' || (s_suppkey % 50) || '?' AS text
FROM supplier""")
view("v_idents", r"""
SELECT query_id, unnest(regexp_extract_all(text, '(?i)\b(?:SKU-[A-Z0-9-]+|FIG-[A-Z0-9-]+|site\s+[0-9]+)\b')) AS ident FROM v_lookups""")


@query("identifier_search", r"""
SELECT query_id, chunk_id, 1.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INT) AS rank
FROM (SELECT DISTINCT query_id, chunk_id FROM v_idents JOIN v_catalog
      ON contains(lower(content), lower(ident)) OR contains(lower(coalesce(caption, '')), lower(ident)))
QUALIFY rank <= 10""")
def identifier_search(t: Views):
    number = F.substring("p_brand", 7, 10)
    parts = t.table("part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("chunk_id"),
        F.concat("p_name", F.lit(" (SKU-"), number, F.lit("-"), "p_partkey", F.lit(") "), "p_type").alias("content"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Stored at site "), "p_size")).alias("caption"),
    )
    asked = t.table("supplier").select(
        F.col("s_suppkey").alias("query_id"),
        F.concat(
            F.lit("Where are SKU-"), "s_nationkey", F.lit("-"), "s_suppkey", F.lit(" and site "),
            F.col("s_suppkey") % 50, F.lit("?"),
        ).alias("text"),
    )
    return lexical.identifier_top(asked, lexical.anchors(parts), K)


# --- fusion ------------------------------------------------------------------------------


def rrf_sql(lists: str, k: int | None, weight: str = "1.0") -> str:
    cut = f"QUALIFY rank <= {k}" if k else ""
    return f"""
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
FROM (SELECT query_id, chunk_id, round(sum(CAST({weight} AS DOUBLE) / (60 + rank)), 9) AS score FROM {lists} GROUP BY ALL) {cut}"""


VISUAL = "CASE WHEN list = 'visual' THEN 0.7 ELSE 1.0 END"
view("v_two", "SELECT * FROM v_sem UNION ALL SELECT * FROM v_kwl")
view("v_hlists", "SELECT * FROM v_sem2 UNION ALL SELECT * FROM v_kwl2 UNION ALL SELECT * FROM v_vis2")
view("v_wlists", r"""
SELECT l.*, CASE WHEN list = 'semantic' THEN w ELSE 1 - w END AS w FROM (SELECT * FROM v_sem2 UNION ALL SELECT * FROM v_kwl2) l
JOIN (SELECT query_id, weight AS w FROM v_qclass) USING (query_id)""")
view("v_hybrid", rrf_sql("v_hlists", K, VISUAL))
view("v_weighted", rrf_sql("v_wlists", K, "w"))
view("v_glists", r"""
SELECT * FROM v_small UNION ALL SELECT * FROM v_large UNION ALL SELECT * FROM v_vis
UNION ALL SELECT l.* FROM v_kwl l JOIN v_route r USING (query_id) WHERE strategy <> 'SEMANTIC'""")
view("v_multi", rrf_sql("v_glists", K, VISUAL))


@query("rrf", rrf_sql("v_two", None))
def rrf(t: Views):
    c = corpus(t)
    return fusion.rrf(fusion.stack(search.semantic(t.queries, c, K), search.keyword(t.queries, c, K)))


@query("hybrid_search", "SELECT * FROM v_hybrid")
def hybrid_search(t: Views):
    return search.hybrid(t.queries, corpus(t), K)


@query("hybrid_weighted", "SELECT * FROM v_weighted")
def hybrid_weighted(t: Views):
    """Without images in scope the weight follows the class of the query."""
    return search.hybrid(t.queries, corpus(t, images=False), K)


@query("multi_granularity", "SELECT * FROM v_multi")
def multi_granularity(t: Views):
    return search.multi_granularity(routed(t), corpus(t), K)


view("v_half", rrf_sql("(SELECT * FROM v_small UNION ALL SELECT * FROM v_large)", 15, "0.5"))
view("v_half_seen", r"""
SELECT query_id, count(*) AS n, bool_or(token_count < 500) AS s, bool_or(token_count >= 500) AS l
FROM v_half JOIN v_corpus USING (chunk_id) GROUP BY query_id""")


@query("merge_diverse", r"""
SELECT query_id, chunk_id, score, rank FROM v_half
UNION ALL
SELECT query_id, chunk_id, score, CAST(n + row_number() OVER (PARTITION BY query_id ORDER BY list DESC) AS INT) AS r
FROM (SELECT * FROM v_small UNION ALL SELECT * FROM v_large) x JOIN v_half_seen USING (query_id)
WHERE rank = 1 AND n < 15 AND ((list = 'small' AND NOT s) OR (list = 'large' AND NOT l))
  AND NOT EXISTS (SELECT 1 FROM v_half h WHERE h.query_id = x.query_id AND h.chunk_id = x.chunk_id)
QUALIFY r <= 15""")
def merge_diverse(t: Views):
    small, large = search.granularity_lists(t.queries, corpus(t), K)
    return fusion.merge_diverse(small, large, t.index.chunks.select("chunk_id", "token_count"), 15)


view("v_core", rrf_sql("v_two", K))
view("v_fresh", r"""
SELECT v.query_id, v.chunk_id, row_number() OVER (PARTITION BY v.query_id ORDER BY v.rank, v.chunk_id) AS pos
FROM v_vis2 v WHERE NOT EXISTS (SELECT 1 FROM v_core c WHERE c.query_id = v.query_id AND c.chunk_id = v.chunk_id)
QUALIFY pos <= 3""")
view("v_kept", r"""
SELECT c.query_id, c.chunk_id, c.rank FROM v_core c
LEFT JOIN (SELECT query_id, count(*) AS m FROM v_fresh GROUP BY ALL) USING (query_id) WHERE rank <= 10 - coalesce(m, 0)""")


@query("visual_splice", r"""
SELECT query_id, chunk_id, rank, 'core' AS origin FROM v_kept
UNION ALL SELECT query_id, chunk_id, CAST(coalesce(n, 0) + pos AS INT), 'visual' FROM v_fresh
LEFT JOIN (SELECT query_id, count(*) AS n FROM v_kept GROUP BY ALL) USING (query_id)""")
def visual_splice(t: Views):
    c = corpus(t)
    core = fusion.rrf(fusion.stack(search.semantic(t.queries, c, K), search.keyword(t.queries, c, K)), K)
    return fusion.splice(core, search.visual(t.queries, c, 2 * K), K)


# --- routing, retries, merges ------------------------------------------------------------

view("v_plain", r"""
SELECT query_id, chunk_id, score, rank, 'KEYWORD' AS strategy_used FROM v_kwl JOIN v_route USING (query_id) WHERE strategy = 'KEYWORD'
UNION ALL SELECT query_id, chunk_id, score, rank, 'SEMANTIC' FROM v_sem JOIN v_route r USING (query_id)
  WHERE strategy = 'SEMANTIC' OR (strategy = 'KEYWORD' AND NOT EXISTS (SELECT 1 FROM v_kwl k WHERE k.query_id = r.query_id))
UNION ALL SELECT query_id, chunk_id, score, rank, 'HYBRID' FROM v_hybrid JOIN v_route USING (query_id) WHERE strategy = 'HYBRID'""")


@query("search_dispatch", "SELECT * FROM v_plain")
def search_dispatch(t: Views):
    return search.search(routed(t), corpus(t), K, use_multi_granularity=False)


view("v_all_semantic", "SELECT query_id, chunk_id, score, rank, 'SEMANTIC' AS strategy_used FROM v_sem")
view("v_retry", r"""
SELECT h.query_id, s.top, h.top AS new FROM (SELECT query_id, max(score) AS top FROM v_hybrid GROUP BY ALL) h
JOIN (SELECT query_id, max(score) AS top FROM v_sem GROUP BY ALL) s USING (query_id) WHERE s.top < 0.5 AND h.top > s.top""")


@query("low_conf_retry", r"""
SELECT * FROM v_all_semantic s WHERE NOT EXISTS (SELECT 1 FROM v_retry r WHERE r.query_id = s.query_id)
UNION ALL SELECT query_id, chunk_id, score, rank, 'HYBRID' FROM v_hybrid JOIN v_retry USING (query_id)""")
def low_conf_retry(t: Views):
    asked = t.queries.withColumn("strategy", F.lit("SEMANTIC"))
    first = search._plain(search.semantic(asked, corpus(t), K), "SEMANTIC")
    return search.retry_low(asked, first, corpus(t), K)


@query("confidence", r"""
SELECT query_id, max(score) AS top_score, CASE WHEN max(score) >= 0.7 THEN 'high' WHEN max(score) >= 0.5 THEN 'low'
       ELSE 'very_low' END AS confidence FROM v_queries LEFT JOIN v_sem USING (query_id) GROUP BY query_id""")
def confidence(t: Views):
    top = search.top_scores(search.semantic(t.queries, corpus(t), K))
    return t.queries.select("query_id").join(top, "query_id", "left").select(
        "query_id", F.col("top").alias("top_score"), search.confidence(F.col("top")).alias("confidence")
    )


def hyde_texts(t: Views):
    """Candidate answers: the rest of each benchmark passage, as a whole and its last sentence."""
    from lodestone.functions import text as tx

    units = t.table("benchmark").select(
        F.col("item_id").alias("query_id"), tx.sentences(tx.strip(F.col("text"))).alias("u")
    )
    rest = units.select("query_id", F.lit(0).alias("n"), F.array_join(F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(0))), " ").alias("text"))
    last = units.select("query_id", F.lit(1).alias("n"), F.element_at("u", -1).alias("text"))
    return rest.unionByName(last)


view("v_bunits", r"""
SELECT item_id AS query_id, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
       '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS u FROM benchmark""")
view("v_hyde_all", r"""
SELECT query_id, 0 AS n, array_to_string(u[2:], ' ') AS text FROM v_bunits UNION ALL SELECT query_id, 1, u[-1] FROM v_bunits""")
HEDGES = " OR ".join("contains(lower(text), '{}')".format(p.replace("'", "''")) for p in un.HEDGING_PHRASES)
view("v_hyde_ok", f"SELECT *, query_id || '#' || n AS hid FROM v_hyde_all WHERE length(trim(text)) BETWEEN 30 AND 600 AND NOT ({HEDGES})")


def _hyde_views():
    from lodestone.plans.views import cosine_sql, sparse_sql

    view("v_hvec", sparse_sql("v_hyde_ok", "hid", "text"))
    view("v_hvec2", "SELECT hid AS query_id, i, w FROM v_hvec")
    view("v_hcos", cosine_sql("v_hvec2", "v_dense"))
    view("v_hyde_hits", top_sql("v_hcos", K))
    view("v_first", "SELECT query_id, chunk_id, score, rank FROM v_weighted")
    view("v_hyde_lists", r"""
SELECT query_id, chunk_id, rank FROM v_first UNION ALL
SELECT CAST(string_split(query_id, '#')[1] AS BIGINT), chunk_id, rank FROM v_hyde_hits""")
    view("v_hyde_merged", rrf_sql("v_hyde_lists", None))
    view("v_hyde_won", r"""
SELECT m.query_id FROM (SELECT query_id, max(score) AS new FROM v_hyde_merged GROUP BY ALL) m
JOIN (SELECT query_id, max(score) AS top FROM v_first GROUP BY ALL) f USING (query_id)
WHERE new > top AND top < 0.5 AND query_id IN (SELECT CAST(string_split(query_id, '#')[1] AS BIGINT) FROM v_hyde_hits)""")


_hyde_views()


@query("hyde_merge", r"""
SELECT query_id, chunk_id, score, rank, 'HYBRID' AS strategy_used FROM v_first WHERE query_id NOT IN (SELECT query_id FROM v_hyde_won)
UNION ALL SELECT query_id, chunk_id, score, rank, 'HYDE' FROM v_hyde_merged WHERE query_id IN (SELECT query_id FROM v_hyde_won)""")
def hyde_merge(t: Views):
    c = corpus(t, images=False)
    return search.hyde_merge(t.queries, search._plain(search.hybrid(t.queries, c, K), "HYBRID"), hyde_texts(t), c, K)


def _variation_views():
    from lodestone.plans.views import cosine_sql, sparse_sql

    view("v_varq", r"""
SELECT query_id || '#' || i AS query_id, query_id AS origin, s AS text FROM (
  SELECT query_id, unnest(u) AS s, generate_subscripts(u, 1) - 1 AS i FROM v_bunits) WHERE i > 0""")
    view("v_vvec", sparse_sql("v_varq", "query_id", "text"))
    view("v_vdcos", cosine_sql("v_vvec", "v_dense"))
    view("v_vterms", r"""
SELECT *, count(*) OVER (PARTITION BY query_id) AS terms FROM (SELECT query_id, token, count(*) AS qtf
FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM v_varq) GROUP BY ALL)""")
    view("v_vkw", bm25_sql("v_ctok", "chunk_id", True).replace("v_qterms", "v_vterms"))
    view("v_vlists", f"""
SELECT *, CASE WHEN list = 'semantic' THEN w ELSE 1 - w END AS share FROM (
  {top_sql('v_vdcos', 2 * K, name='semantic')}) JOIN (SELECT query_id, {weight_sql('text')} AS w FROM v_varq) USING (query_id)
UNION ALL SELECT *, 1 - w FROM ({top_sql('v_vkw', 2 * K, name='keyword')})
JOIN (SELECT query_id, {weight_sql('text')} AS w FROM v_varq) USING (query_id)""")
    view("v_vhybrid", rrf_sql("v_vlists", K, "share"))
    view("v_low", "SELECT query_id FROM v_sem GROUP BY ALL HAVING max(score) >= 0.5 AND max(score) < 0.7")
    view("v_mq_lists", r"""
SELECT query_id, chunk_id, rank FROM v_sem UNION ALL
SELECT CAST(string_split(query_id, '#')[1] AS BIGINT) AS qid, chunk_id, rank FROM v_vhybrid WHERE qid IN (SELECT query_id FROM v_low)""")
    view("v_mq_hit", r"""
SELECT DISTINCT CAST(string_split(query_id, '#')[1] AS BIGINT) AS query_id FROM v_vhybrid
WHERE CAST(string_split(query_id, '#')[1] AS BIGINT) IN (SELECT query_id FROM v_low)""")
    view("v_mq", rrf_sql("(SELECT * FROM v_mq_lists WHERE query_id IN (SELECT query_id FROM v_mq_hit))", None))


def phrases_sql(column: str, phrases: list[str]) -> str:
    return " + ".join("contains(lower({}), '{}')::INT".format(column, p.replace("'", "''")) for p in phrases)


def weight_sql(column: str) -> str:
    kw, sem = phrases_sql(column, un.KEYWORD_TRIGGERS), phrases_sql(column, un.SEMANTIC_TRIGGERS)
    low, high = max(0.4, 0.7 - 0.2), min(0.85, 0.7 + 0.1)
    return f"CASE WHEN {kw} > {sem} THEN {low!r}::DOUBLE WHEN {sem} > {kw} THEN {high!r}::DOUBLE ELSE 0.7::DOUBLE END"


view("v_qclass", f"SELECT query_id, {weight_sql('text')} AS weight FROM v_queries")
view("v_route", r"""
SELECT query_id, CASE WHEN text = '' THEN 'HYBRID'
  WHEN regexp_matches(text, '\p{Nd}') OR contains(text, '"') OR contains(text, '''') OR len(string_split_regex(text, '\s+')) <= 4 THEN 'KEYWORD'
  WHEN """ + f"({phrases_sql('text', un.ROUTE_TRIGGERS)}) > 0" + r""" THEN 'SEMANTIC' ELSE 'HYBRID' END AS strategy FROM v_queries""")
_variation_views()


def variations_of(t: Views):
    """The further sentences of each benchmark passage."""
    from lodestone.functions import text as tx

    units = F.posexplode(tx.sentences(tx.strip(F.col("text")))).alias("n", "text")
    return t.table("benchmark").select(F.col("item_id").alias("query_id"), units).where("n > 0")


@query("multi_query_merge", r"""
SELECT query_id, chunk_id, score, rank, 'SEMANTIC' AS strategy_used FROM v_sem WHERE query_id NOT IN (SELECT query_id FROM v_mq_hit)
UNION ALL SELECT query_id, chunk_id, score, rank, 'MULTI_QUERY' FROM v_mq""")
def multi_query_merge(t: Views):
    c = corpus(t, images=False)
    first = search._plain(search.semantic(t.queries, c, K), "SEMANTIC")
    return search.multi_query_merge(t.queries, first, variations_of(t), c, K, use_multi_granularity=False)


def _scoped_merge_views():
    """The merges above for queries with a scope: every hit of a derived query is held to it."""
    fits = "(s.ws IS NULL OR s.ws = k.workspace_id) AND (s.usr IS NULL OR s.usr = k.user_id)"
    origin = "CAST(string_split({0}.query_id, '#')[1] AS BIGINT)"

    def held(source: str) -> str:
        return f"SELECT c.* FROM {source} c JOIN v_scoped s ON s.query_id = {origin.format('c')} JOIN v_corpus k USING (chunk_id) WHERE {fits}"

    view("v_sfirst", top_sql("v_scoped_cos", K))
    view("v_shcos", held("v_hcos"))
    view("v_shits", top_sql("v_shcos", K))
    view("v_slists", f"SELECT query_id, chunk_id, rank FROM v_sfirst UNION ALL SELECT {origin.format('h')}, chunk_id, rank FROM v_shits h")
    view("v_smerged", rrf_sql("v_slists", None))
    view("v_swon", f"""
SELECT m.query_id FROM (SELECT query_id, max(score) AS new FROM v_smerged GROUP BY ALL) m
JOIN (SELECT query_id, max(score) AS top FROM v_sfirst GROUP BY ALL) f USING (query_id)
WHERE new > top AND top < 0.5 AND query_id IN (SELECT {origin.format('h')} FROM v_shits h)""")
    view("v_svd", held("v_vdcos"))
    view("v_svk", held("v_vkw"))
    view("v_svlists", f"""
SELECT *, CASE WHEN list = 'semantic' THEN w ELSE 1 - w END AS share FROM ({top_sql('v_svd', 2 * K, name='semantic')})
JOIN (SELECT query_id, {weight_sql('text')} AS w FROM v_varq) USING (query_id)
UNION ALL SELECT *, 1 - w FROM ({top_sql('v_svk', 2 * K, name='keyword')}) JOIN (SELECT query_id, {weight_sql('text')} AS w FROM v_varq) USING (query_id)""")
    view("v_svhybrid", rrf_sql("v_svlists", K, "share"))
    view("v_slow", "SELECT query_id FROM v_sfirst GROUP BY ALL HAVING max(score) >= 0.5 AND max(score) < 0.7")
    view("v_smq_hit", f"SELECT DISTINCT {origin.format('h')} AS query_id FROM v_svhybrid h WHERE {origin.format('h')} IN (SELECT query_id FROM v_slow)")
    view("v_smq_lists", f"""
SELECT query_id, chunk_id, rank FROM v_sfirst WHERE query_id IN (SELECT query_id FROM v_smq_hit)
UNION ALL SELECT {origin.format('h')} AS qid, chunk_id, rank FROM v_svhybrid h WHERE qid IN (SELECT query_id FROM v_smq_hit)""")
    view("v_smq", rrf_sql("v_smq_lists", None))


_scoped_merge_views()


@query("hyde_scoped", r"""
SELECT query_id, chunk_id, score, rank, 'SEMANTIC' AS strategy_used FROM v_sfirst WHERE query_id NOT IN (SELECT query_id FROM v_swon)
UNION ALL SELECT query_id, chunk_id, score, rank, 'HYDE' FROM v_smerged WHERE query_id IN (SELECT query_id FROM v_swon)""")
def hyde_scoped(t: Views):
    c, asked = corpus(t, images=False), scoped_queries(t)
    return search.hyde_merge(asked, search._plain(search.semantic(asked, c, K), "SEMANTIC"), hyde_texts(t), c, K)


@query("multi_query_scoped", r"""
SELECT query_id, chunk_id, score, rank, 'SEMANTIC' AS strategy_used FROM v_sfirst WHERE query_id NOT IN (SELECT query_id FROM v_smq_hit)
UNION ALL SELECT query_id, chunk_id, score, rank, 'MULTI_QUERY' FROM v_smq""")
def multi_query_scoped(t: Views):
    c, asked = corpus(t, images=False), scoped_queries(t)
    first = search._plain(search.semantic(asked, c, K), "SEMANTIC")
    return search.multi_query_merge(asked, first, variations_of(t), c, K, use_multi_granularity=False)


view("v_cand", r"""
SELECT query_id, chunk_id, q.text, trim(coalesce(c.caption, '') || ' ' || c.content) AS passage, v.score, v.rank
FROM v_rerank_in v JOIN v_corpus c USING (chunk_id) JOIN v_queries q USING (query_id)""")
view("v_wide", f"""
SELECT l.*, CASE WHEN list = 'semantic' THEN weight ELSE 1 - weight END AS w
FROM ({top_sql('v_cos', 6 * K, name='semantic')} UNION ALL {top_sql('v_kw', 6 * K, name='keyword')}) l
JOIN v_qclass USING (query_id)""")
view("v_rerank_in", rrf_sql("v_wide", 3 * K, "w"))
view("v_model", r"""
SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), regexp_extract_all(lower(passage), '[a-z0-9]+')))
  / greatest(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), 1) AS model, count(*) OVER (PARTITION BY query_id) AS n
FROM v_cand""")
view("v_mixed", r"""
SELECT *, round((1 - 0.3::DOUBLE) * CASE WHEN max(model) OVER w > min(model) OVER w THEN (model - min(model) OVER w) / (max(model) OVER w - min(model) OVER w) ELSE 0.5 END
  + 0.3::DOUBLE * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END, 6) AS mix
FROM v_model WINDOW w AS (PARTITION BY query_id)""")


@query("rerank_blend", r"""
SELECT query_id, chunk_id, CASE WHEN n > 10 THEN mix ELSE score END AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 THEN mix ELSE -rank END DESC, chunk_id) AS INT) AS new_rank
FROM v_mixed QUALIFY new_rank <= 10""")
def rerank_blend(t: Views):
    c = corpus(t, images=False)
    found = search.hybrid(t.queries, c, 3 * K)
    rich = found.join(t.queries, "query_id").join(t.index.chunks.select("chunk_id", "content", "caption"), "chunk_id")
    return search.rerank(rich, K).select("query_id", "chunk_id", "score", F.col("rank").alias("new_rank"))
