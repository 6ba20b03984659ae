"""Tenancy, document tables and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunking, containing, conversations as cv, tenancy, search
from lodestone.plans.registry import query, view
from lodestone.plans.retrieval import K, corpus, top_sql
from lodestone.plans.views import Views, at, stamp
from lodestone.sources import tables as st

FMT = "'%Y-%m-%d %H:%M:%S'"

view("v_access", r"""
SELECT event_id, CASE WHEN user_id % 8 < 7 THEN 'u' || (user_id % 8) END AS user_id,
  CASE WHEN user_id % 3 > 0 THEN 'src' || (user_id % 20) END AS workspace_id, user_id % 50 = 0 AS is_admin,
  CAST(event_id AS VARCHAR) AS document_id, 'src' || (event_id % 25) AS target FROM events""")


def access_log(t: Views):
    u = F.col("user_id")
    return t.table("events").select(
        "event_id",
        F.when(u % 8 < 7, F.concat(F.lit("u"), u % 8)).alias("user_id"),
        F.when(u % 3 > 0, F.concat(F.lit("src"), u % 20)).alias("workspace_id"),
        (u % 50 == 0).alias("is_admin"),
        F.col("event_id").cast("string").alias("document_id"),
        F.concat(F.lit("src"), F.col("event_id") % 25).alias("target"),
    )


view("v_scopes", r"""
SELECT DISTINCT CASE WHEN doc_id % 9 < 6 THEN 'u' || (doc_id % 9) END AS user_id,
  CASE WHEN doc_id % 9 IN (1, 4, 7) THEN 'src' || (doc_id % 9 + 2) END AS workspace_id FROM documents""")
view("v_asked", r"""
SELECT item_id AS request_id, 'u' || (item_id % 7) AS user_id, CASE WHEN item_id % 4 = 0 THEN 'src' || (item_id % 20) END AS chat_ws,
  'src' || (item_id % 20) AS workspace_id, CASE WHEN item_id % 10 = 9 THEN '' ELSE 'OC_' || (item_id % 30) END AS name_term,
  ' ' || upper(CASE WHEN item_id % 5 = 4 THEN right(text, 2) WHEN item_id % 5 = 3 THEN left(text, 4) ELSE right(text, 9) END) || ' ' AS said_term FROM benchmark""")


def scopes(t: Views):
    """Requests with a user, a workspace, both or none."""
    n = F.col("doc_id") % 9
    return t.table("documents").select(
        F.when(n < 6, F.concat(F.lit("u"), n)).alias("user_id"),
        F.when(n.isin(1, 4, 7), F.concat(F.lit("src"), n + 2)).alias("workspace_id"),
    ).distinct()


def asked(t: Views):
    """Requests with a term for names and one for what was said: parts of benchmark texts."""
    n, text = F.col("item_id"), F.col("text")
    part = F.when(n % 5 == 4, F.right(text, F.lit(2))).when(n % 5 == 3, F.left(text, F.lit(4))).otherwise(F.right(text, F.lit(9)))
    return t.table("benchmark").select(
        n.alias("request_id"), F.concat(F.lit("u"), n % 7).alias("user_id"),
        F.when(n % 4 == 0, F.concat(F.lit("src"), n % 20)).alias("chat_ws"), F.concat(F.lit("src"), n % 20).alias("workspace_id"),
        F.when(n % 10 == 9, "").otherwise(F.concat(F.lit("OC_"), n % 30)).alias("name_term"),
        F.concat(F.lit(" "), F.upper(part), F.lit(" ")).alias("said_term"),
    )


@query("scope_filter", r"""
SELECT s.user_id AS scope_user_id, s.workspace_id AS scope_workspace_id, c.chunk_id, c.document_id FROM v_chunks c JOIN v_docs d USING (document_id)
JOIN v_scopes s ON (s.user_id IS NULL OR s.user_id = d.user_id) AND (s.workspace_id IS NULL OR s.workspace_id = d.workspace_id) WHERE d.status = 'ready'""")
def scope_filter(t: Views):
    docs = containing.by_scope(scopes(t), search.scope_filter(t.docs), ["user_id", "workspace_id"])
    kept = docs.select("scope_user_id", "scope_workspace_id", "document_id")
    return t.index.chunks.select("chunk_id", "document_id").join(kept, "document_id")


@query("doc_access", r"""
SELECT event_id, d.document_id IS NOT NULL AND NOT coalesce(d.user_id <> a.user_id, false) AND (
    a.is_admin OR (d.workspace_id IS NULL AND a.workspace_id IS NULL) OR coalesce(d.workspace_id = a.workspace_id, false)
    OR (d.workspace_id IS NULL AND a.user_id IS NOT NULL AND (d.user_id IS NULL OR d.user_id = a.user_id))
    OR coalesce(w.user_id = a.user_id, false)) AS allowed
FROM v_access a LEFT JOIN v_docs d USING (document_id) LEFT JOIN v_workspaces w ON w.id = d.workspace_id""")
def doc_access(t: Views):
    return tenancy.document_access(access_log(t), t.docs, t.workspaces).select("event_id", "allowed")


@query("ws_access", r"""
SELECT event_id, a.is_admin OR coalesce(a.workspace_id = a.target, false) OR coalesce(w.user_id = a.user_id, false) AS allowed
FROM v_access a LEFT JOIN v_workspaces w ON w.id = a.target""")
def ws_access(t: Views):
    return tenancy.workspace_access(access_log(t), t.workspaces).select("event_id", "allowed")


@query("list_documents", f"""
SELECT s.user_id AS scope_user_id, s.workspace_id AS scope_workspace_id, document_id, name, status, strftime(created_at, {FMT}) AS created_at
FROM v_docs d JOIN v_scopes s ON (s.user_id IS NULL OR d.user_id IS NULL OR d.user_id = s.user_id) AND CASE WHEN s.workspace_id IS NOT NULL
  THEN coalesce(d.workspace_id = s.workspace_id, false) ELSE d.workspace_id IS NULL OR coalesce(d.workspace_id IN (SELECT id FROM v_workspaces w WHERE w.user_id = s.user_id), false) END""")
def list_documents(t: Views):
    listed = tenancy.listings(scopes(t), t.docs, t.workspaces)
    return listed.select("scope_user_id", "scope_workspace_id", "document_id", "name", "status", stamp("created_at").alias("created_at"))


@query("doc_search", r"""
SELECT a.request_id, d.document_id FROM v_asked a JOIN v_docs d ON d.workspace_id = a.workspace_id AND contains(lower(d.name), lower(a.name_term))""")
def doc_search(t: Views):
    terms = asked(t).select("request_id", "workspace_id", F.lower("name_term").alias("term"))
    return terms.join(tenancy.name_hits(terms, t.docs), ["workspace_id", "term"]).select("request_id", "document_id")


@query("ready_docs", r"""
SELECT s.workspace_id AS scope_workspace_id, document_id, name FROM v_docs d JOIN (SELECT DISTINCT workspace_id FROM v_scopes) s
  ON s.workspace_id IS NULL OR s.workspace_id = d.workspace_id WHERE status = 'ready'""")
def ready_docs(t: Views):
    return tenancy.ready_in(scopes(t), t.docs).select("scope_workspace_id", "document_id", "name")


@query("context_chunk", r"""
SELECT c.chunk_id AS request_id, c.chunk_id, CASE WHEN ok THEN 1.0::DOUBLE END AS score, 'CHUNK' AS strategy_used,
  CASE WHEN ok THEN 'found' ELSE 'not_found' END AS outcome
FROM (SELECT c.chunk_id, (c.token_count % 3 = 0 OR coalesce(d.workspace_id = 'src' || (c.token_count % 20), false))
        AND d.document_id IS NOT NULL AND (c.token_count % 2 = 0 OR coalesce(d.user_id = 'u' || (c.token_count % 7), false)) AS ok
      FROM v_corpus c LEFT JOIN v_docs d USING (document_id)) c""")
def context_chunk(t: Views):
    n = F.col("token_count")
    asked = t.index.chunks.select(
        F.col("chunk_id").alias("request_id"), "chunk_id",
        F.when(n % 3 != 0, F.concat(F.lit("src"), n % 20)).alias("workspace_id"),
        F.when(n % 2 != 0, F.concat(F.lit("u"), n % 7)).alias("user_id"),
    )
    return tenancy.context_chunk(asked, t.index.chunks, t.docs)


@query("retrieval_outcome", r"""
SELECT q.query_id, count(s.chunk_id) AS hits, CASE WHEN count(s.chunk_id) > 0 THEN 'ok'
  WHEN q.query_id % 2 = 0 THEN 'no_chunks_in_scope' ELSE 'no_chunks' END AS outcome
FROM v_queries q LEFT JOIN (SELECT s.query_id, s.chunk_id FROM v_sem s JOIN v_corpus c USING (chunk_id)
  WHERE s.query_id % 2 = 1 OR TRY_CAST(c.document_id AS BIGINT) BETWEEN s.query_id * 5 AND s.query_id * 5 + 200) s USING (query_id)
GROUP BY q.query_id""")
def retrieval_outcome(t: Views):
    start = F.col("query_id") * 5
    allowed = F.transform(F.sequence(start, start + 200), lambda x: x.cast("string"))
    asked = t.queries.withColumn("document_ids", F.when(F.col("query_id") % 2 == 0, allowed))
    ranked = search.semantic(t.queries, corpus(t), K).join(t.index.chunks.select("chunk_id", "document_id"), "chunk_id")
    return tenancy.retrieval_outcome(asked, ranked)


view("v_users", r"""
SELECT DISTINCT 'u' || (doc_id % 9) AS user_id, CASE WHEN doc_id % 9 IN (1, 4) THEN 'src' || (doc_id % 9 + 7) END AS default_workspace_id FROM documents""")


def users(t: Views):
    n = F.col("doc_id") % 9
    return t.table("documents").select(
        F.concat(F.lit("u"), n).alias("user_id"),
        F.when(n.isin(1, 4), F.concat(F.lit("src"), n + 7)).alias("default_workspace_id"),
    ).distinct()


@query("resolve_ws", r"""
SELECT event_id, coalesce(given_ws, CASE WHEN user_id IS NOT NULL THEN user_ws END, tenant_ws, CASE WHEN user_id IS NOT NULL
  THEN coalesce(default_workspace_id, owned, 'My workspace') END) AS resolved
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'src' || (event_id % 20) END AS given_ws,
        CASE WHEN user_id % 10 < 9 THEN 'u' || (user_id % 10) END AS user_id, CASE WHEN event_id % 5 = 1 THEN 'src1' END AS user_ws,
        CASE WHEN event_id % 5 = 2 THEN 'src2' END AS tenant_ws FROM events)
LEFT JOIN v_users USING (user_id) LEFT JOIN (SELECT user_id, min(id) AS owned FROM v_workspaces GROUP BY ALL) USING (user_id)""")
def resolve_ws(t: Views):
    e, u = F.col("event_id") % 5, F.col("user_id")
    uploads = t.table("events").select(
        "event_id",
        F.when(e == 0, F.concat(F.lit("src"), F.col("event_id") % 20)).alias("given_ws"),
        F.when(u % 10 < 9, F.concat(F.lit("u"), u % 10)).alias("user_id"),
        F.when(e == 1, "src1").alias("user_ws"),
        F.when(e == 2, "src2").alias("tenant_ws"),
    )
    return tenancy.resolve_workspace(uploads, users(t), t.workspaces).select("event_id", "resolved")


@query("file_size", r"""
SELECT o_orderkey, CASE WHEN b = 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', round(b / pow(1024, p), 2)), '0+$', ''), '\.$', '')
  || ' ' || ['Bytes', 'KB', 'MB', 'GB'][p + 1] END AS size
FROM (SELECT *, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 ELSE 3 END AS p
      FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 1000) * (o_orderkey % 100) AS b FROM orders))""")
def file_size(t: Views):
    size = F.floor("o_totalprice") * (F.col("o_orderkey") % 1000) * (F.col("o_orderkey") % 100)
    return t.table("orders").select("o_orderkey", tenancy.file_size(size).alias("size"))


@query("workspace_counts", r"""
SELECT w.id, w.user_id, count(d.document_id) AS documents FROM v_workspaces w LEFT JOIN v_docs d
  ON d.workspace_id = w.id AND (d.user_id = w.user_id OR d.user_id IS NULL) GROUP BY ALL""")
def workspace_counts(t: Views):
    return tenancy.workspace_counts(t.workspaces, t.docs)


@query("doc_stats", r"""
SELECT count(*) AS documents, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'processing') AS processing,
  CAST(sum(file_size) AS BIGINT) AS total_size FROM v_docs""")
def doc_stats(t: Views):
    return tenancy.document_stats(t.docs)


@query("page_cap", r"""
SELECT document_id, CAST(i AS INT) AS page_number, s AS content FROM v_lines WHERE i <= 20""")
def page_cap(t: Views):
    lines = t.pages.select("document_id", F.posexplode(F.split("content", "\n")).alias("i", "s"))
    pages = lines.select("document_id", (F.col("i") + 1).alias("page_number"), tx.strip(F.col("s")).alias("content"))
    return tenancy.first_pages(pages)


view("v_skills", r"""SELECT DISTINCT lower(p_type) AS name, 'Do ' || p_type AS action FROM part""")


@query("skill_resolve", r"""
SELECT p_partkey, coalesce(b.action, o.action) AS instruction
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE p_name END AS skill, 'u' || (p_partkey % 7) AS user_id FROM part) r
LEFT JOIN v_skills b ON b.name = r.skill
LEFT JOIN (SELECT DISTINCT p_name AS name, 'u' || (length(p_name) % 7) AS user_id, 'Own ' || p_name AS action FROM part) o
  ON o.name = r.skill AND o.user_id = r.user_id""")
def skill_resolve(t: Views):
    part = t.table("part")
    builtin = part.select(F.lower("p_type").alias("name"), F.concat(F.lit("Do "), "p_type").alias("action")).distinct()
    own = part.select(
        F.col("p_name").alias("name"), F.concat(F.lit("u"), F.length("p_name") % 7).alias("user_id"),
        F.concat(F.lit("Own "), "p_name").alias("action"),
    ).distinct()
    asked = part.select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_name")).alias("skill"),
        F.concat(F.lit("u"), F.col("p_partkey") % 7).alias("user_id"),
    )
    return tenancy.resolve_skills(asked, builtin, own).select("p_partkey", "instruction")


# --- snapshots ---------------------------------------------------------------------------


@query("load_passages", r"""
SELECT doc_id, text AS passage FROM documents
WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20""")
def load_passages(t: Views):
    return st.load_passages(t.table("documents"), "doc_id").select("doc_id", "passage")


view("v_incoming", r"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(quality * 10 + toxic AS BIGINT) AS chunk_count, 'ready' AS status, '2025-01-01' AS updated_at FROM labels
UNION ALL SELECT 'b' || item_id, CAST(length(text) AS BIGINT), 'ready', '2025-01-01' FROM benchmark""")


@query("upsert", f"""
SELECT document_id, coalesce(i.chunk_count, d.chunk_count) AS chunk_count, coalesce(i.status, d.status) AS status, coalesce(i.updated_at, d.updated_at) AS updated_at
FROM v_incoming i FULL JOIN (SELECT document_id, file_size AS chunk_count, status, strftime(created_at, {FMT}) AS updated_at FROM v_docs) d USING (document_id)""")
def upsert(t: Views):
    old = t.docs.select("document_id", F.col("file_size").alias("chunk_count"), "status", stamp("created_at").alias("updated_at"))
    day = F.lit("2025-01-01").alias("updated_at")
    new = t.table("labels").select(
        F.col("doc_id").cast("string").alias("document_id"),
        (F.col("quality") * 10 + F.col("toxic")).cast("bigint").alias("chunk_count"), F.lit("ready").alias("status"), day,
    ).unionByName(
        t.table("benchmark").select(
            F.concat(F.lit("b"), "item_id").alias("document_id"), F.length("text").cast("bigint").alias("chunk_count"),
            F.lit("ready").alias("status"), day,
        )
    )
    return tenancy.upsert_documents(old, new)


@query("replace_chunks", r"""
SELECT chunk_id, document_id, token_count FROM v_chunks_raw WHERE
  CASE WHEN document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) THEN granularity = 'large' ELSE granularity = 'small' END""")
def replace_chunks(t: Views):
    """Labelled documents are chunked anew with large chunks only."""
    labelled = t.table("labels").select(F.col("doc_id").cast("string").alias("document_id"))
    cols = ["chunk_id", "document_id", "token_count"]
    old = chunking.chunk_rows(t.pages, sizes={"small": chunking.DEFAULT.small_tokens}).select(cols)
    again = t.pages.join(labelled, "document_id", "left_semi")
    new = chunking.chunk_rows(again, sizes={"large": chunking.DEFAULT.large_tokens}).select(cols)
    return tenancy.replace_chunks(old, new)


@query("cascade_delete", r"""
SELECT 'document' AS kind, document_id AS id FROM v_docs WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
UNION ALL SELECT 'chunk', chunk_id FROM v_chunks_raw WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def cascade_delete(t: Views):
    doomed = t.table("labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    docs, chunks = tenancy.delete_documents(t.docs, t.chunks_raw, doomed)
    return docs.select(F.lit("document").alias("kind"), F.col("document_id").alias("id")).unionByName(
        chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    )


view("v_ws_gone", r"""
SELECT id FROM (SELECT w.id, CASE WHEN w.id = 'src2' THEN 'My workspace' ELSE w.id END AS name, w.user_id FROM v_workspaces w)
WHERE id IN ('src1', 'src2', 'src8', 'src11') AND name <> 'My workspace' AND id <> coalesce(CASE WHEN user_id = 'u4' THEN 'src11' END, '')""")


@query("workspace_delete", r"""
SELECT 'workspace' AS kind, id FROM v_workspaces WHERE id NOT IN (SELECT id FROM v_ws_gone)
UNION ALL SELECT 'document', document_id FROM v_docs WHERE workspace_id NOT IN (SELECT id FROM v_ws_gone)
UNION ALL SELECT 'chunk', chunk_id FROM v_chunks_raw JOIN v_docs USING (document_id) WHERE workspace_id NOT IN (SELECT id FROM v_ws_gone)
UNION ALL SELECT 'default', user_id || ':' || coalesce(CASE WHEN default_workspace_id NOT IN (SELECT id FROM v_ws_gone) THEN default_workspace_id END, '') FROM v_users""")
def workspace_delete(t: Views):
    ws = t.workspaces.withColumn("name", F.when(F.col("id") == "src2", tenancy.NEW_WORKSPACE).otherwise(F.col("id")))
    people = users(t).withColumn("current_workspace_id", F.when(F.col("user_id") == "u4", "src11"))
    doomed = t.workspaces.where(F.col("id").isin("src1", "src2", "src8", "src11")).select("id")
    w, u, d, c = tenancy.delete_workspaces(ws, people, t.docs, t.chunks_raw, doomed)

    def tagged(df, kind, col):
        return df.select(F.lit(kind).alias("kind"), col.alias("id"))

    pointer = F.concat("user_id", F.lit(":"), F.coalesce("default_workspace_id", F.lit("")))
    return (
        tagged(w, "workspace", F.col("id"))
        .unionByName(tagged(d, "document", F.col("document_id")))
        .unionByName(tagged(c, "chunk", F.col("chunk_id")))
        .unionByName(tagged(u, "default", pointer))
    )


@query("purge", "SELECT document_id, status FROM v_docs WHERE status <> 'error'")
def purge(t: Views):
    return tenancy.purge(t.docs).select("document_id", "status")


view("v_status", r"""
SELECT document_id, CASE WHEN n IS NULL THEN 'error' ELSE 'ready' END AS status, coalesce(n, 0) AS chunk_count,
  CASE WHEN n IS NULL THEN 'No text content found in document' END AS error_message
FROM v_docs LEFT JOIN (SELECT document_id, count(*) AS n FROM v_chunks GROUP BY ALL) USING (document_id)""")


@query("ingest_status", "SELECT * FROM v_status")
def ingest_status(t: Views):
    return tenancy.finalize_status(t.docs.select("document_id", "status"), t.chunks)


@query("doc_status", r"""
SELECT document_id, status, CASE WHEN status = 'ready' THEN chunk_count END AS chunk_count,
  CASE WHEN status = 'error' THEN error_message END AS error FROM v_status""")
def doc_status(t: Views):
    return tenancy.status_view(tenancy.finalize_status(t.docs.select("document_id", "status"), t.chunks))


@query("stuck_sweep", r"""
SELECT document_id, CASE WHEN s THEN 'error' ELSE status END AS status, CASE WHEN s THEN 'Processing stuck (server restarted?)' END AS error_message
FROM (SELECT *, status = 'processing' AND created_at < TIMESTAMP '2024-01-01 08:00:00' - INTERVAL 5 MINUTE AS s FROM v_docs)""")
def stuck_sweep(t: Views):
    docs = t.docs.select("document_id", "status", F.col("created_at").alias("updated_at"))
    return tenancy.sweep_stuck(docs, "2024-01-01 08:00:00").drop("updated_at")


# --- conversations -----------------------------------------------------------------------

view("v_titles", r"""
SELECT conversation_id, CASE WHEN length(t) > 40 THEN t[:40] || '...' ELSE t END AS title
FROM (SELECT conversation_id, min_by(content, turn) AS t FROM v_messages WHERE role = 'user' GROUP BY ALL)""")
view("v_convs", r"""
SELECT *, 'u' || (conversation_id % 7) AS user_id, 'src' || (conversation_id % 20) AS workspace_id, conversation_id % 5 = 0 AS is_pinned
FROM (SELECT conversation_id, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS messages FROM v_messages GROUP BY ALL)
LEFT JOIN v_titles USING (conversation_id)""")


def convs(t: Views):
    c = F.col("conversation_id")
    return (
        cv.summaries(t.messages, cv.auto_titles(t.messages))
        .withColumn("user_id", F.concat(F.lit("u"), c % 7))
        .withColumn("workspace_id", F.concat(F.lit("src"), c % 20))
        .withColumn("is_pinned", c % 5 == 0)
    )


@query("conv_title", r"""
SELECT conversation_id, coalesce(CASE WHEN conversation_id % 4 = 0 THEN 'Named ' || conversation_id END, t.title, CASE WHEN conversation_id % 4 = 1 THEN 'New Chat' END) AS title
FROM v_convs LEFT JOIN v_titles t USING (conversation_id)""")
def conv_title(t: Views):
    c = F.col("conversation_id")
    given = F.when(c % 4 == 0, F.concat(F.lit("Named "), c)).when(c % 4 == 1, "New Chat")
    return cv.auto_titles(t.messages, t.messages.select("conversation_id").distinct().withColumn("title", given))


@query("conv_search", r"""
SELECT a.request_id, c.conversation_id FROM v_asked a JOIN v_convs c ON c.user_id = a.user_id AND (a.chat_ws IS NULL OR a.chat_ws = c.workspace_id)
WHERE contains(lower(coalesce(nullif(c.title, ''), 'New Chat')), lower(trim(a.said_term))) OR EXISTS (
  SELECT 1 FROM v_messages m WHERE m.conversation_id = c.conversation_id AND contains(lower(m.content), lower(trim(a.said_term))))""")
def conv_search(t: Views):
    terms = asked(t).select("request_id", "user_id", F.col("chat_ws").alias("workspace_id"), F.col("said_term").alias("term"))
    return cv.hits(terms, convs(t), t.messages)


@query("conv_export", r"""
SELECT conversation_id, -1::BIGINT AS turn, 0 AS part, '# ' || title AS line FROM v_titles
UNION ALL SELECT conversation_id, turn, 0, CASE WHEN role = 'user' THEN '## User' ELSE '## Assistant' END FROM v_messages
UNION ALL SELECT conversation_id, turn, 1, regexp_replace(content, '^\s+|\s+$', '', 'g') FROM v_messages
UNION ALL SELECT conversation_id, turn, 2, '**Sources:**' FROM v_messages WHERE role = 'assistant'
UNION ALL SELECT conversation_id, turn, 3, '- [1] doc_' || turn || '.txt' || CASE WHEN turn % 2 = 1 THEN ', p.' || turn ELSE '' END FROM v_messages WHERE role = 'assistant'""")
def conv_export(t: Views):
    n = F.col("turn")
    cites = F.array(F.struct(F.concat(F.lit("doc_"), n, F.lit(".txt")).alias("document_name"), F.when(n % 2 == 1, n).alias("page_number")))
    return cv.markdown_lines(t.messages.withColumn("citations", cites), cv.auto_titles(t.messages))


@query("conv_text", r"""
SELECT conversation_id, turn, upper(role[1]) || role[2:] || ': ' || regexp_replace(content, '^\s+|\s+$', '', 'g') AS line
FROM v_messages WHERE regexp_replace(content, '\s+', '', 'g') <> ''""")
def conv_text(t: Views):
    return cv.transcript(t.messages)


@query("conv_nested", r"""
SELECT conversation_id, turn // 4 AS segment, string_agg(turn || ' ' || role || ' ' || content, '|' ORDER BY turn) AS messages, count(*) AS n
FROM v_messages GROUP BY ALL""")
def conv_nested(t: Views):
    rows = cv.nested(t.messages, segment=4)
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws(" ", m["turn"], m["role"], m["content"])), "|")
    return rows.select("conversation_id", "segment", text.alias("messages"), F.size("messages").cast("bigint").alias("n"))


@query("pinned_split", r"""
SELECT conversation_id, turn, CASE WHEN p THEN 'pinned' ELSE 'rest' END AS bucket
FROM (SELECT *, turn IN (1, 2) AND conversation_id % 2 = 0 AS p FROM v_messages) WHERE NOT p OR role = 'assistant'""")
def pinned_split(t: Views):
    pinned = t.messages.where("turn in (1, 2) and conversation_id % 2 = 0").select("conversation_id", "turn")
    return cv.pinned_split(t.messages, pinned).select("conversation_id", "turn", "bucket")


@query("turn_pairs", r"""
SELECT conversation_id, turn, question, content AS answer FROM (
  SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question
  FROM v_messages) WHERE role = 'assistant'""")
def turn_pairs(t: Views):
    return cv.turn_pairs(t.messages).select("conversation_id", "turn", "question", F.col("content").alias("answer"))


@query("conv_recent", f"""
SELECT s.user_id AS scope_user_id, s.workspace_id AS scope_workspace_id, conversation_id, title, strftime(updated_at, {FMT}) AS updated_at
FROM v_convs c JOIN v_scopes s ON (s.user_id IS NULL OR s.user_id = c.user_id) AND (s.workspace_id IS NULL OR s.workspace_id = c.workspace_id)
QUALIFY row_number() OVER (PARTITION BY s.user_id, s.workspace_id ORDER BY c.updated_at DESC, conversation_id) <= 50""")
def conv_recent(t: Views):
    listed = cv.recent_in(scopes(t), convs(t))
    return listed.select("scope_user_id", "scope_workspace_id", "conversation_id", "title", stamp("updated_at").alias("updated_at"))


@query("conv_pinned", r"""
SELECT conversation_id, is_pinned, messages, CAST(row_number() OVER (
  PARTITION BY workspace_id ORDER BY coalesce(is_pinned, false) DESC, updated_at DESC, conversation_id) AS INT) AS place FROM v_convs""")
def conv_pinned(t: Views):
    return cv.pinned_places(convs(t)).select("conversation_id", "is_pinned", "messages", "place")


@query("conv_recent5", r"""
SELECT workspace_id, conversation_id, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY updated_at DESC, conversation_id) AS INT) AS place
FROM v_convs QUALIFY place <= 5""")
def conv_recent5(t: Views):
    return cv.recent_per_workspace(convs(t)).select("workspace_id", "conversation_id", "place")


@query("conv_merge", r"""
SELECT conversation_id, 'remote' AS source FROM v_convs WHERE messages > 4
UNION ALL SELECT conversation_id, 'local' FROM v_convs WHERE messages <= 6 AND conversation_id NOT IN (SELECT conversation_id FROM v_convs WHERE messages > 4)""")
def conv_merge(t: Views):
    c = convs(t)
    return cv.merge_remote(c.where("messages > 4"), c.where("messages <= 6"), limit=None).select("conversation_id", "source")


@query("reply_threads", r"""
SELECT m.conversation_id, m.turn, p.role AS parent_role, length(p.content) AS parent_chars FROM v_messages m
LEFT JOIN v_messages p ON p.conversation_id = m.conversation_id AND p.turn = m.turn - 1""")
def reply_threads(t: Views):
    m = t.messages.withColumn("parent_turn", F.col("turn") - 1)
    return cv.reply_threads(m).select("conversation_id", "turn", "parent_role", F.length("parent_content").cast("bigint").alias("parent_chars"))


@query("version_chain", r"""
WITH RECURSIVE d AS (SELECT doc_id AS id, CASE WHEN doc_id % 200 = 50 THEN doc_id + 49 WHEN doc_id % 50 > 0 THEN doc_id - 1 - (doc_id % 3 // 2) END AS prev FROM documents),
e AS (SELECT d.id, p.id AS prev FROM d LEFT JOIN d p ON d.prev = p.id),
walk AS (SELECT id, id AS root, 0 AS depth FROM e WHERE prev IS NULL
         UNION ALL SELECT e.id, w.root, w.depth + 1 FROM walk w JOIN e ON e.prev = w.id),
best AS (SELECT root, arg_max(CAST(id AS VARCHAR), (depth, CAST(id AS VARCHAR))) AS newest FROM walk GROUP BY root)
SELECT CAST(e.id AS VARCHAR) AS document_id, CAST(w.root AS VARCHAR) AS root, CAST(w.depth AS BIGINT) AS depth, b.newest
FROM e LEFT JOIN walk w ON w.id = e.id LEFT JOIN best b ON b.root = w.root""")
def version_chain(t: Views):
    """Documents replace the one before them, some the one before that; every fourth run of fifty leads into itself."""
    i = F.col("doc_id")
    before = F.when(i % 200 == 50, i + 49).when(i % 50 > 0, i - 1 - F.floor((i % 3) / 2))
    docs = t.table("documents").select(i.cast("string").alias("document_id"), before.cast("string").alias("previous_document_id"))
    return tenancy.version_chain(docs).select("document_id", "root", "depth", "newest")
