"""Chunking and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vec
from lodestone.operators import chunking
from lodestone.plans.registry import query, view
from lodestone.plans.views import Views, sparse_sql


@query("sentences", r"""
SELECT document_id, CAST(unnest(range(len(units))) AS INT) AS pos, unnest(units) AS unit FROM v_units""")
def sentences(t: Views):
    return t.pages.select("document_id", F.posexplode(tx.sentences(F.col("content"))).alias("pos", "unit"))


view("v_lines", r"""
SELECT document_id, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM (
  SELECT document_id, unnest(string_split(content, chr(10))) AS s,
         generate_subscripts(string_split(content, chr(10)), 1) AS i FROM v_docs WHERE content <> '')""")
view("v_kinds", r"""
SELECT *, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^#{1,6}\s+.+$') OR regexp_matches(s, '^[0-9]+\.\s+[A-Z][^\n]+$')
  OR regexp_matches(s, '^(\*{2,}|_{2,})[^\n]+(\*{2,}|_{2,})$') OR regexp_matches(s, '^[A-Z][A-Z\s]{3,}:$')
  OR regexp_matches(s, '^[-=]{3,}$') THEN 'head' ELSE 'body' END AS kind FROM v_lines""")
view("v_islands", r"""
SELECT *, sum(CASE WHEN kind = 'body' AND prev = 'body' THEN 0 ELSE 1 END)
          OVER (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT *, lag(kind) OVER (PARTITION BY document_id ORDER BY i) AS prev FROM v_kinds)""")
view("v_paras", r"""
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY g) - 1 AS INT) AS pos, unit
FROM (SELECT document_id, g, string_agg(s, ' ' ORDER BY i) AS unit FROM v_islands WHERE kind <> 'blank' GROUP BY ALL)""")


@query("paragraphs", "SELECT document_id, pos, unit FROM v_paras")
def paragraphs(t: Views):
    return t.pages.select("document_id", F.posexplode(tx.paragraphs(F.col("content"))).alias("pos", "unit"))


@query("chunk_pack", r"""
SELECT document_id, chunk_index, content, token_count FROM v_chunks_raw WHERE granularity = 'small'""")
def chunk_pack(t: Views):
    rows = chunking.chunk_rows(t.pages, sizes={"small": chunking.DEFAULT.small_tokens})
    return rows.select("document_id", "chunk_index", "content", "token_count")


@query("chunk_multi", "SELECT chunk_id, document_id, granularity, chunk_index, content, token_count FROM v_chunks_raw")
def chunk_multi(t: Views):
    return t.chunks_raw.select("chunk_id", "document_id", "granularity", "chunk_index", "content", "token_count")


@query("para_pack", r"""
SELECT document_id, CAST(unnest(range(len(packs))) AS INT) AS pos, unnest(packs) AS pack FROM (
  SELECT document_id, list_append(f.done, f.cur) AS packs FROM (
    SELECT document_id, list_reduce(ps, lambda a, p: CASE WHEN a.has AND a.n + length(p) > 400
        THEN {'done': list_append(a.done, a.cur), 'cur': p, 'has': true, 'n': length(p)}
        ELSE {'done': a.done, 'cur': CASE WHEN a.has THEN a.cur || chr(10) || chr(10) || p ELSE p END, 'has': true, 'n': a.n + length(p)} END,
        {'done': []::VARCHAR[], 'cur': '', 'has': false, 'n': 0::BIGINT}) AS f
    FROM (SELECT document_id, list(unit ORDER BY pos) AS ps FROM v_paras GROUP BY document_id)))""")
def para_pack(t: Views):
    text = F.array_join(tx.paragraphs(F.col("content")), "\n\n")
    return t.pages.select("document_id", F.posexplode(chunking.paragraph_packs(text)).alias("pos", "pack"))


@query("prune", "SELECT chunk_id, document_id, token_count FROM v_scored WHERE keep")
def prune(t: Views):
    keep = chunking.keep_chunk(F.col("content"), F.col("token_count"), F.lit("text"))
    return t.chunks_raw.where(keep).select("chunk_id", "document_id", "token_count")


@query("granularity_split", r"""
SELECT CASE WHEN token_count < 500 THEN 'small' ELSE 'large' END AS size_class, granularity AS packed_as,
       count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM v_chunks_raw GROUP BY ALL""")
def granularity_split(t: Views):
    size = F.when(F.col("token_count") < 500, "small").otherwise("large")
    return t.chunks_raw.groupBy(size.alias("size_class"), F.col("granularity").alias("packed_as")).agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens")
    )


@query("chunk_hash", "SELECT chunk_id, content_hash FROM v_scored")
def chunk_hash(t: Views):
    return t.chunks_raw.select("chunk_id", chunking.content_hash(F.col("content")).alias("content_hash"))


@query("chunk_dedup", "SELECT chunk_id, document_id, position, content_hash FROM v_deduped")
def chunk_dedup(t: Views):
    return t.chunks.select("chunk_id", "document_id", "position", "content_hash")


@query("chunk_score", "SELECT chunk_id, round(score, 6) AS score FROM v_scored")
def chunk_score(t: Views):
    score = chunking.quality_score(F.col("content"), F.col("token_count"))
    return t.chunks_raw.select("chunk_id", F.round(score, 6).alias("score"))


@query("embed_select", "SELECT chunk_id, document_id, token_count, selected FROM v_chunks")
def embed_select(t: Views):
    return t.chunks.select("chunk_id", "document_id", "token_count", "selected")


view("v_doc_vec", sparse_sql("v_docs", "document_id", "content"))


@query("lexical_vec", r"""
SELECT document_id, CAST(i AS INT) AS i, round(w / n, 6) AS w FROM v_doc_vec
JOIN (SELECT document_id, sqrt(sum(w * w)) AS n FROM v_doc_vec GROUP BY ALL) USING (document_id) WHERE w <> 0""")
def lexical_vec(t: Views):
    v = t.docs.select("document_id", F.posexplode(vec.lexical_vector(F.col("content"))).alias("i", "w"))
    return v.where("w <> 0").select("document_id", "i", F.round("w", 6).alias("w"))
