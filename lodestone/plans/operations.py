"""Cache, metrics, structured chunks, admission and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import understand as un
from lodestone.functions import vectors as vec
from lodestone.operators import admission, cache, metrics, sequences, structured
from lodestone.plans.registry import query, view
from lodestone.plans.views import Views, cosine_sql, sparse_sql, stamp
from lodestone.sources import html, tables as st

HASH = r"sha256(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')))[:16]"
TTL = "CASE WHEN " + " OR ".join(f"contains(lower({{0}}), '{p}')" for p in un.TIME_PHRASES) + " THEN 3600 ELSE 86400 END"

# --- cache -------------------------------------------------------------------------------

view("v_entries", f"""
SELECT ns, query, {HASH.format('query')} AS query_hash, stored_at, date_trunc('second', stored_at) + to_seconds({TTL.format('query')}) AS expires_at
FROM (SELECT ns, query, min(ts) AS stored_at FROM v_query_log GROUP BY ALL)""")


def entries(t: Views):
    """The first answer to every query of the log."""
    return cache.store(t.query_log.groupBy("ns", "query").agg(F.min("ts").alias("stored_at")))


@query("cache_exact", f"""
SELECT event_id, EXISTS (SELECT 1 FROM v_entries e WHERE e.ns = l.ns AND e.query_hash = {HASH.format('l.query')}
  AND e.stored_at <= l.ts AND e.expires_at > l.ts) AS hit FROM v_query_log l""")
def cache_exact(t: Views):
    return cache.exact_lookup(t.query_log, entries(t)).select("event_id", "hit")


@query("cache_expiry", r"""
SELECT ns, query, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM v_entries
WHERE stored_at <= TIMESTAMP '2024-01-02 02:00:00' AND expires_at > TIMESTAMP '2024-01-02 02:00:00'""")
def cache_expiry(t: Views):
    kept = cache.live(entries(t), F.lit("2024-01-02 02:00:00").cast("timestamp"))
    return kept.select("ns", "query", stamp("expires_at").alias("expires_at"))


view("v_replay", f"""
SELECT ns, query_hash, requests, CAST(list_reduce(secs, lambda a, s: CASE WHEN s >= a.e THEN {{'e': s + ttl, 'm': a.m + 1}} ELSE a END,
  {{'e': -1::BIGINT, 'm': 0::BIGINT}}).m AS BIGINT) AS misses
FROM (SELECT ns, {HASH.format('query')} AS query_hash, count(*) AS requests, any_value({TTL.format('query')}) AS ttl,
        list(CAST(floor(epoch(ts)) AS BIGINT) ORDER BY ts) AS secs FROM v_query_log GROUP BY ALL)""")


def replayed(t: Views):
    return cache.replay(t.query_log).groupBy("ns", "query_hash").agg(
        F.sum("requests").alias("requests"), F.sum("misses").alias("misses")
    )


@query("cache_replay", "SELECT ns, query_hash, requests, misses FROM v_replay")
def cache_replay(t: Views):
    return replayed(t)


@query("cache_stats", r"""
SELECT * FROM (SELECT count(*) AS entries, count(*) FILTER (expires_at <= TIMESTAMP '2024-01-02 02:00:00') AS expired,
    count(*) FILTER (expires_at > TIMESTAMP '2024-01-02 02:00:00') AS active FROM v_entries),
  (SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(requests) - sum(misses) AS BIGINT) AS hits,
     round((sum(requests) - sum(misses)) / sum(requests), 6) AS reduction FROM v_replay)""")
def cache_stats(t: Views):
    table = cache.stats(entries(t), F.lit("2024-01-02 02:00:00").cast("timestamp"))
    saved = cache.call_reduction(replayed(t))
    return table.select("*", *[saved.select(c).scalar().alias(c) for c in ("requests", "hits", "reduction")])


view("v_said", r"""
SELECT conversation_id * 100 + turn AS query_id, 'n' || (conversation_id % 3) AS ns, content, created_at FROM v_messages WHERE role = 'user'""")
view("v_said_old", "SELECT *, query_id AS chunk_id FROM v_said")
view("v_said_new", "SELECT query_id, ns, content || ' now' AS content FROM v_said")
view("v_said_ovec", sparse_sql("v_said_old", "chunk_id", "content"))
view("v_said_nvec", sparse_sql("v_said_new", "query_id", "content"))
view("v_said_cos", cosine_sql("v_said_nvec", "v_said_ovec"))


@query("cache_semantic", f"""
SELECT query_id, chunk_id AS entry_id, score FROM v_said_cos c JOIN v_said_new n USING (query_id) JOIN v_said_old o USING (chunk_id)
WHERE n.ns = o.ns AND score >= 0.95 AND o.created_at <= TIMESTAMP '2024-01-02 02:00:00'
  AND o.created_at + to_seconds({TTL.format('o.content')}) > TIMESTAMP '2024-01-02 02:00:00' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1""")
def cache_semantic(t: Views):
    """User turns are cached; the same turns with one more word are asked."""
    said = t.messages.where("role = 'user'").select(
        (F.col("conversation_id") * 100 + F.col("turn")).alias("query_id"),
        F.concat(F.lit("n"), F.col("conversation_id") % 3).alias("ns"), "content", "created_at",
    )
    kept = cache.store(
        said.select(F.col("query_id").alias("entry_id"), "ns", F.col("content").alias("query"), F.col("created_at").alias("stored_at"))
    ).withColumn("vec", vec.lexical_counts(F.col("query")))
    asked = said.select("query_id", "ns", F.concat("content", F.lit(" now")).alias("query"))
    asked = asked.withColumn("vec", vec.lexical_counts(F.col("query")))
    return cache.semantic_lookup(asked, kept, F.lit("2024-01-02 02:00:00").cast("timestamp"))


@query("cache_invalidate", r"""
SELECT conversation_id, turn FROM v_messages WHERE conversation_id % 3 = 0 OR NOT (turn = 5 OR conversation_id = 5)""")
def cache_invalidate(t: Views):
    c = F.col("conversation_id")
    table = t.messages.select(
        "conversation_id", "turn", F.when(c % 3 == 0, "documents:x").otherwise("rag:exact:x").alias("key"),
        F.array(F.col("turn").cast("string"), c.cast("string")).alias("cited"),
    )
    return cache.invalidate(table, "5").select("conversation_id", "turn")


view("v_known", r"""
SELECT DISTINCT content_hash FROM v_chunks WHERE document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")


def reuse(t: Views):
    """Embedded chunks; those of labelled documents were embedded before."""
    from lodestone.operators.slots import reuse_plan

    labelled = t.table("labels").select(F.col("doc_id").cast("string").alias("document_id"))
    chosen = t.index.chunks.where("selected and chunk_type = 'text'").select("chunk_id", "document_id", "content_hash")
    return reuse_plan(chosen, chosen.join(labelled, "document_id", "left_semi"), "content_hash")


view("v_reuse", r"""
SELECT c.chunk_id, c.content_hash IN (SELECT k.content_hash FROM v_chunks k JOIN v_docs e USING (document_id)
  WHERE e.status = 'ready' AND k.document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)) AS reused
FROM v_chunks c JOIN v_docs d USING (document_id) WHERE d.status = 'ready'""")


@query("embed_reuse", "SELECT chunk_id, reused FROM v_reuse")
def embed_reuse(t: Views):
    return reuse(t).select("chunk_id", "reused")


@query("embed_stats", r"""
SELECT count(*) FILTER (NOT reused) AS total_embeddings, count(*) FILTER (reused) AS cache_hits,
  round(count(*) FILTER (reused) / count(*), 6) AS hit_rate FROM v_reuse""")
def embed_stats(t: Views):
    hits, fresh = F.count_if(F.col("reused")), F.count_if(~F.col("reused"))
    return reuse(t).agg(
        fresh.alias("total_embeddings"), hits.alias("cache_hits"), F.round(metrics.ratio(hits, fresh), 6).alias("hit_rate")
    )


# --- metrics -----------------------------------------------------------------------------

view("v_last", r"""
SELECT path, latency FROM v_requests""")
view("v_latency", r"""
SELECT path, count(*) AS count, min(latency) AS min, max(latency) AS max, round(avg(latency), 6) AS avg,
  list_sort(list(latency))[count(*) // 2 + 1] AS p50,
  CASE WHEN count(*) >= 20 THEN list_sort(list(latency))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] ELSE max(latency) END AS p95,
  CASE WHEN count(*) >= 100 THEN list_sort(list(latency))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] ELSE max(latency) END AS p99
FROM v_last GROUP BY path""")


@query("latency_summary", "SELECT * FROM v_latency")
def latency_summary(t: Views):
    return metrics.latency_summary(t.requests, "path", "latency", ["ts", "event_id"])


@query("latency_recent", r"""
SELECT status, count(*) AS count, min(latency) AS min, max(latency) AS max, round(avg(latency), 6) AS avg,
  list_sort(list(latency))[count(*) // 2 + 1] AS p50,
  CASE WHEN count(*) >= 20 THEN list_sort(list(latency))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] ELSE max(latency) END AS p95,
  CASE WHEN count(*) >= 100 THEN list_sort(list(latency))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] ELSE max(latency) END AS p99
FROM (SELECT * FROM v_requests QUALIFY row_number() OVER (PARTITION BY status ORDER BY ts DESC, event_id DESC) <= 5000)
WHERE latency IS NOT NULL GROUP BY status""")
def latency_recent(t: Views):
    """The last 5,000 requests of each outcome."""
    return metrics.latency_summary(t.requests, "status", "latency", ["ts", "event_id"], kept=5000)


@query("requests_recent", r"""
SELECT client, path, event_id FROM v_requests QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) <= 2000""")
def requests_recent(t: Views):
    """The last 2,000 requests of each path."""
    return sequences.newest(t.requests, ["path"], ["ts", "event_id"], 2000).select("client", "path", "event_id")


view("v_buckets", "\nUNION ALL ".join(
    f"SELECT path, '{b}' AS le, count(*) FILTER (latency / 10 <= {b}) AS count FROM v_requests GROUP BY path" for b in metrics.BOUNDS
) + "\nUNION ALL SELECT path, '+Inf', count(*) FROM v_requests GROUP BY path")


@query("latency_buckets", "SELECT * FROM v_buckets")
def latency_buckets(t: Views):
    return metrics.latency_buckets(t.requests, "path", F.col("latency") / 10)


view("v_counters", r"""
SELECT 'http_requests_total{path="' || path || '",status="' || status || '"}' AS key, count(*) AS value FROM v_requests GROUP BY path, status""")
view("v_gauges", r"""
SELECT 'client_last_latency{client="' || client || '"}' AS key, arg_max(latency, {'t': ts, 'e': event_id}) AS value FROM v_requests GROUP BY client""")


def points(t: Views):
    labels = F.create_map(F.lit("status"), F.col("status").cast("string"), F.lit("path"), F.col("path"))
    return t.requests.select(F.lit("http_requests_total").alias("name"), labels.alias("labels"), F.lit(1).alias("value"))


def gauge_points(t: Views):
    labels = F.create_map(F.lit("client"), F.col("client").cast("string"))
    return t.requests.select(
        F.lit("client_last_latency").alias("name"), labels.alias("labels"), F.col("latency").alias("value"), "ts", "event_id"
    )


def gauge_values(t: Views):
    return metrics.gauges(gauge_points(t), F.struct("ts", "event_id"))


@query("counters", "SELECT key, value::DOUBLE AS value FROM v_counters UNION ALL SELECT key, value FROM v_gauges")
def counters(t: Views):
    total = metrics.counters(points(t)).select("key", F.col("value").cast("double").alias("value"))
    return total.unionByName(gauge_values(t))


PLAIN = "regexp_replace(printf('%.6f', {0}), '0{{1,5}}$', '')"


@query("metrics_text", f"""
SELECT key, 0 AS seq, '# TYPE http_requests_total counter' AS line FROM v_counters
UNION ALL SELECT key, 1, key || ' ' || value FROM v_counters
UNION ALL SELECT key, 0, '# TYPE client_last_latency gauge' FROM v_gauges
UNION ALL SELECT key, 1, key || ' ' || {PLAIN.format('value')} FROM v_gauges
UNION ALL SELECT k, unnest([0, 1, 2, 3, 4]), unnest(['# TYPE http_request_latency summary',
    'http_request_latency{{path="' || path || '",quantile="0.5"}} ' || {PLAIN.format('p50')},
    'http_request_latency{{path="' || path || '",quantile="0.95"}} ' || {PLAIN.format('p95')},
    'http_request_latency_count ' || count, 'http_request_latency_sum ' || {PLAIN.format('round(avg * count, 2)')}])
  FROM (SELECT *, 'http_request_latency{{path="' || path || '"}}' AS k FROM v_latency)
UNION ALL SELECT path, unnest([0, 1, 2]), unnest(['# TYPE ' || path || '_seconds histogram', path || '_seconds_count ' || n,
    path || '_seconds_sum ' || {PLAIN.format('round(s, 2)')}]) FROM (SELECT path, count(*) AS n, sum(latency / 10) AS s FROM v_requests GROUP BY path)
UNION ALL SELECT path, list_position(['0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1.0', '2.5', '5.0', '10.0', '+Inf'], le) + 2,
    path || '_seconds_bucket{{le="' || le || '"}} ' || count FROM v_buckets""")
def metrics_text(t: Views):
    last = metrics.latency_summary(t.requests, "path", "latency", ["ts", "event_id"])
    summaries = last.select(
        F.concat(F.lit('http_request_latency{path="'), "path", F.lit('"}')).alias("key"), "p50",
        F.when(F.col("count") >= 20, F.col("p95")).alias("p95"), "count", F.round(F.col("avg") * F.col("count"), 2).alias("sum"),
    )
    totals = t.requests.groupBy(F.col("path").alias("name")).agg(
        F.count("*").alias("total"), F.round(F.sum(F.col("latency") / 10), 2).alias("sum")
    )
    timers = metrics.latency_buckets(t.requests, "path", F.col("latency") / 10).withColumnRenamed("path", "name").join(totals, "name")
    return metrics.exposition(metrics.counters(points(t)), gauge_values(t), summaries, timers)


@query("request_metrics", r"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, path, status, count(*) AS requests,
  round(avg(latency), 6) AS avg_latency, max(latency) AS max_latency FROM v_requests GROUP BY ALL""")
def request_metrics(t: Views):
    return metrics.request_metrics(t.requests).withColumn("hour", stamp("w.start")).drop("w")


@query("admission", r"""
WITH RECURSIVE secs AS (SELECT user_id % 5 AS client, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events GROUP BY ALL),
folded AS (SELECT client, list_reduce(list({'s': second, 'n': n} ORDER BY second),
  lambda a, r: list_transform([{'m': list_filter(a.m, lambda x: x > r.s - 60), 'h': list_filter(a.h, lambda x: x > r.s - 3600)}],
    lambda f: list_transform([least(r.n, greatest(1 - len(f.m), 0))], lambda took: {
      'm': list_concat(f.m, list_transform(range(took), lambda z: r.s)),
      'h': list_concat(f.h, list_transform(range(least(took, greatest(2 - len(f.h), 0))), lambda z: r.s)),
      'o': list_append(a.o, {'s': r.s, 'n': r.n, 'a': least(took, greatest(2 - len(f.h), 0)), 'rm': r.n - took,
                             'rh': took - least(took, greatest(2 - len(f.h), 0))})})[1])[1],
  {'m': []::BIGINT[], 'h': []::BIGINT[], 'o': []::STRUCT(s BIGINT, n BIGINT, a BIGINT, rm BIGINT, rh BIGINT)[]}).o AS o FROM secs GROUP BY client)
SELECT client, x.s AS second, x.n AS requests, x.a AS admitted, x.rm AS refused_minute, x.rh AS refused_hour FROM (SELECT client, unnest(o) AS x FROM folded)""")
def admission_(t: Views):
    """Five busy clients under tight limits."""
    busy = t.requests.select((F.col("client") % 5).alias("client"), "ts")
    return admission.admit(busy, per_minute=1, per_hour=2)


# --- structured chunks -------------------------------------------------------------------

view("v_cells", r"""
SELECT document_id, list_transform(string_split(content, chr(10)), lambda l: list_transform(string_split(l, ', '), lambda c: nullif(c, ''))) AS rows
FROM v_docs WHERE content <> ''""")
view("v_clean", r"""
SELECT document_id, rows, list_transform(rows, lambda r: list_transform(r, lambda c: trim(replace(coalesce(c, ''), chr(10), ' ')))) AS t FROM v_cells""")


def cells(t: Views):
    """Lines of a document as table rows, split at commas."""
    rows = F.transform(
        F.split("content", "\n"), lambda r: F.transform(F.split(r, ", "), lambda c: F.nullif(c, F.lit("")))
    )
    return t.pages.select("document_id", rows.alias("rows"))


ROW = "'| ' || array_to_string(list_concat({r}, list_transform(range({w} - len({r})), lambda z: '')), ' | ') || ' |'"
RULE = "'| ' || array_to_string(list_transform(range({w}), lambda z: '---'), ' | ') || ' |'"


@query("table_md", f"""
SELECT document_id, array_to_string(list_concat([{ROW.format(r='t[1]', w='w')}, {RULE.format(w='w')}],
    list_transform(t[2:], lambda r: {ROW.format(r='r', w='w')})), chr(10)) AS md,
  'Table: ' || array_to_string(list_transform(list_filter(rows[1], lambda c: c IS NOT NULL), lambda c: trim(c)), ' | ') AS caption
FROM (SELECT *, list_max(list_transform(t, lambda r: len(r))) AS w FROM v_clean)""")
def table_md(t: Views):
    return cells(t).select(
        "document_id", structured.table_markdown(F.col("rows")).alias("md"), structured.table_caption(F.col("rows")).alias("caption")
    )


@query("table_rows", f"""
SELECT document_id, CAST(pos - 1 AS INT) AS pos, {ROW.format(r='h', w='w')} || chr(10) || {RULE.format(w='w')} || chr(10) || {ROW.format(r='r', w='w')} AS md
FROM (SELECT *, greatest(len(h), len(r)) AS w FROM (SELECT document_id, t[1] AS h, unnest(t[2:]) AS r, generate_subscripts(t[2:], 1) AS pos
      FROM v_clean WHERE len(t) > 2))""")
def table_rows(t: Views):
    return cells(t).select("document_id", F.posexplode(structured.row_markdown(F.col("rows"))).alias("pos", "md"))


@query("bbox_flip", r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x0, least(792 - b, 792 - t) AS y0, l_quantity + 10 AS x1, greatest(792 - b, 792 - t) AS y1
FROM (SELECT *, floor(l_extendedprice / 200) AS t, floor(l_extendedprice / 200) + l_quantity - 20 AS b FROM lineitem)""")
def bbox_flip(t: Views):
    top = F.floor(F.col("l_extendedprice") / 200)
    q = F.col("l_quantity")
    box = structured.flip_box(q, top, q + 10, top + q - 20, F.lit(792.0))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("b")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.*"
    )


view("v_blocks", r"""
SELECT l_orderkey AS page_id, l_quantity * 10 AS x0, floor(l_extendedprice / 100) AS y0, l_quantity * 10 + 60 AS x1,
  floor(l_extendedprice / 100) + 12 AS y1, 'part ' || l_partkey || ' supplier ' || l_suppkey AS words FROM lineitem""")
view("v_images", r"""
SELECT o_orderkey AS image_id, o_orderkey AS page_id, (o_custkey % 40) * 10.0 AS x0, floor(o_totalprice / 500) AS y0,
  (o_custkey % 40) * 10.0 + 150 AS x1, floor(o_totalprice / 500) + 100 AS y1 FROM orders""")


@query("nearest_caption", r"""
SELECT image_id, coalesce(arg_min(words, {'g': round(g, 6), 'w': words}), '')[:400] AS caption FROM v_images LEFT JOIN (
  SELECT * FROM (SELECT i.image_id, b.words,
    CASE WHEN i.y0 - b.y1 BETWEEN 0 AND 80 THEN i.y0 - b.y1 WHEN b.y0 - i.y1 BETWEEN 0 AND 80 THEN b.y0 - i.y1 + 0.1 END AS g
  FROM v_images i JOIN v_blocks b ON b.page_id = i.page_id AND NOT (b.x1 < i.x0 - 8 OR b.x0 > i.x1 + 8)) WHERE g IS NOT NULL) USING (image_id)
GROUP BY image_id""")
def nearest_caption(t: Views):
    """Line items play the text blocks of a page, orders the images."""
    q, top = F.col("l_quantity"), F.floor(F.col("l_extendedprice") / 100)
    blocks = t.table("lineitem").select(
        F.col("l_orderkey").alias("page_id"), (q * 10).alias("x0"), top.alias("y0"), (q * 10 + 60).alias("x1"), (top + 12).alias("y1"),
        F.concat(F.lit("part "), "l_partkey", F.lit(" supplier "), "l_suppkey").alias("text"),
    )
    left, y = (F.col("o_custkey") % 40) * 10.0, F.floor(F.col("o_totalprice") / 500)
    images = t.table("orders").select(
        F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").alias("page_id"), left.alias("x0"), y.alias("y0"),
        (left + 150).alias("x1"), (y + 100).alias("y1"),
    )
    return structured.nearest_caption(images, blocks)


def parsed(t: Views):
    return html.parse(t.spread(t.table("pages"), "page_id"), "page_id", "html")


@query("parse_pages")
def parse_pages(t: Views):
    """One row for each page, failed ones included."""
    return parsed(t)


@query("parse_stats", r"""
SELECT count(*) AS total_documents, count(*) FILTER (good) AS successes, count(*) FILTER (NOT good) AS failures,
  round(count(*) FILTER (good) * 100.0 / count(*), 1) AS success_rate, count(*) FILTER (good) AS total_pages,
  round(count(*) FILTER (good) / (sum(n) / 1000), 1) AS pages_per_sec
FROM (SELECT coalesce(regexp_matches(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<head.*?</head>', '', 'g'),
        '<[^>]*>', '', 'g'), '\S'), false) AS good, coalesce(length(html), 0) AS n FROM pages)""")
def parse_stats(t: Views):
    """Totals of the parse job. Nothing in the tables says how long a page took; its length in characters stands for milliseconds."""
    took = t.table("pages").select("page_id", F.coalesce(F.length("html"), F.lit(0)).alias("parse_ms"))
    pages = F.coalesce("page_number", F.lit(0)).alias("pages")
    return st.parse_stats(parsed(t).select("page_id", pages).join(took, "page_id"))
