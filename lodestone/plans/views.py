"""The working tables, derived from the given ones, in Spark and in check SQL."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vec
from lodestone.operators import chunking, index, knn
from lodestone.plans.registry import view
from lodestone.session import apply_settings, checkpoint_dir, ship_package

EPOCH = "2024-01-01 00:00:00"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def at(base_seconds):
    """Timestamp that many seconds after the start of the data."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + base_seconds)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        ship_package(apply_settings(spark))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """Use every core when the rows of an input lie in few splits.

        Splits are cut by bytes, but a Parquet row group is read whole by the one split that holds its middle: a file of
        one row group is the work of one task, however many splits it has. So the rows of the splits are counted, from
        the footers alone. An input whose fullest split has little more than a core's share is left as it is.
        """
        cores, splits = self.spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
        rows = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        if splits >= cores and cores * (rows["most"] or 0) <= 2 * (rows["all"] or 0):
            return df
        return df.repartition(max(cores, splits), key)

    @cached_property
    def docs(self) -> DataFrame:
        d = self.spread(self.table("documents"), "doc_id")
        return d.select(
            F.col("doc_id").cast("string").alias("document_id"),
            F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"),
            tx.strip(F.col("text")).alias("content"),
            F.col("source").alias("workspace_id"),
            F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("u"), F.col("doc_id") % 7)).alias("user_id"),
            F.when(F.col("n_chars") < 120, "error").when(F.col("doc_id") % 37 == 5, "processing").otherwise("ready").alias("status"),
            F.col("n_chars").alias("file_size"),
            at(F.col("doc_id") * 60).alias("created_at"),
        )

    @cached_property
    def workspaces(self) -> DataFrame:
        return self.table("documents").select(F.col("source").alias("id")).distinct().withColumn(
            "user_id", F.concat(F.lit("u"), F.regexp_extract("id", "([0-9]+)", 1).cast("int") % 7)
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.docs.select("document_id", F.lit(None).cast("int").alias("page_number"), "content").where("content <> ''")

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"), tx.sentences(tx.strip(F.col("text")))[0].alias("text")
        )

    @cached_property
    def messages(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(
            F.col("conv_id").alias("conversation_id"),
            "turn",
            "role",
            F.coalesce("text", F.lit("")).alias("content"),
            at(F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            "event_id",
            "ts",
            F.col("user_id").alias("client"),
            F.col("event_type").alias("path"),
            F.col("value").alias("latency"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        )

    @cached_property
    def query_log(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            "event_id",
            "ts",
            (F.col("user_id") % 3).cast("string").alias("ns"),
            F.concat(
                "event_type", F.lit(" "), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")
            ).alias("query"),
        )

    @cached_property
    def chunks_raw(self) -> DataFrame:
        return chunking.chunk_rows(self.pages)

    @cached_property
    def chunks(self) -> DataFrame:
        return chunking.ingest(self.pages, one_page=True)

    @cached_property
    def figures(self) -> DataFrame:
        """One figure chunk per raw page; its title is the caption."""
        p = self.spread(self.table("pages"), "page_id")
        title = tx.strip(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
        label = F.when(title != "", title).otherwise(F.concat(F.lit("Figure on page "), "page_id"))
        content = F.concat(F.lit("[Figure] "), label)
        return p.select(
            F.concat(F.lit("p"), "page_id").alias("document_id"),
            F.concat(F.lit("p"), "page_id", F.lit("-f")).alias("chunk_id"),
            content.alias("content"),
            F.greatest(tx.token_estimate(content), F.lit(1)).alias("token_count"),
            label.alias("caption"),
        )

    @cached_property
    def corpus(self) -> DataFrame:
        """Searchable chunks of ready documents and of page figures, without vectors. All are embedded; `embed_select` shows the budgeted choice."""
        ready = self.docs.where("status = 'ready' AND content <> ''").withColumn("page_number", F.lit(None).cast("int"))
        text = (
            chunking.ingest(ready, one_page=True, carry=("workspace_id", "user_id"))
            .where("content <> ''")
            .select(
                "chunk_id", "document_id", "workspace_id", "user_id", "content", "token_count",
                F.lit("text").alias("chunk_type"), F.lit(None).cast("string").alias("caption"), "content_hash", F.lit(True).alias("selected"),
            )
        )
        figures = self.figures.select(
            "chunk_id", "document_id", F.lit("web").alias("workspace_id"), F.lit(None).cast("string").alias("user_id"),
            "content", "token_count", F.lit("figure").alias("chunk_type"), "caption",
            chunking.content_hash(F.col("content")).alias("content_hash"), F.lit(True).alias("selected"),
        )
        return text.unionByName(figures)

    def _once(self, name: str, tables: tuple[str, ...], write) -> str:
        """Path that `write` has filled, once per application and state of the input tables."""
        path = f"{checkpoint_dir(self.spark)}/{name}-{self.spark.sparkContext.applicationId}-{self._state(tables)}"
        if not self._exists(f"{path}/done/_SUCCESS"):
            write(path)
            self.spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
        return path

    @cached_property
    def index(self) -> index.Index:
        """Search index of the corpus, each part written once per application and state of the input, when a query needs it."""
        return index.Stored(self.spark, lambda: self.corpus, lambda name, write: self._once(f"index-{name}", ("documents", "pages"), write))

    @cached_property
    def doc_index(self) -> index.Index:
        """Search index of whole documents, each as one text."""
        none = F.lit(None).cast("string").alias("caption")
        columns = ["document_id", "workspace_id", "user_id", "content", none, F.lit(0).alias("token_count"), F.lit("text").alias("chunk_type"), F.lit(True).alias("selected")]
        source = lambda: self.docs.select(F.col("document_id").alias("chunk_id"), *columns)
        return index.Stored(self.spark, source, lambda name, write: self._once(f"docs-{name}", ("documents",), write))

    @cached_property
    def index_with_lists(self) -> index.Index:
        path = self._once("lists", ("documents", "pages"), lambda path: index.write_lists(self.index, path))
        return index.with_lists(self.index, path)

    @cached_property
    def index_with_places(self) -> index.Index:
        path = self._once("places", ("documents", "pages"), lambda path: index.write_places(self.index, path))
        return index.with_places(self.index, path)

    @cached_property
    def vector_lists(self) -> knn.Lists:
        """Inverted lists of the given vectors."""
        side = self.table("embeddings").select("vec_id", F.col("embedding").alias("vec"))
        return knn.read_lists(self.spark, self._once("vectors", ("embeddings",), lambda path: knn.write_lists(side, path, "vec_id")), "vec_id")

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._hadoop(path)
        return fs.exists(where)

    def _state(self, tables: tuple[str, ...]) -> str:
        """Fingerprint of the input files."""
        seen = []
        for name in tables:
            where, fs = self._hadoop(f"{self.dir}/{name}.parquet")
            total = fs.getContentSummary(where)
            seen.append(f"{where}:{total.getLength()}:{fs.getFileStatus(where).getModificationTime()}")
        return hashlib.sha256("|".join(seen).encode()).hexdigest()[:16]

    @cached_property
    def query_vectors(self) -> DataFrame:
        return self.queries.select("query_id", vec.lexical_counts(F.col("text")).alias("vec"))


def label_vectors(t: Views) -> DataFrame:
    """Mean vector of every label; the query side of the kNN queries."""
    e = t.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec")
    ).select(F.col("label").cast("bigint").alias("query_id"), "vec")


view("v_docs", r"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, 'doc_' || doc_id || '.txt' AS name,
       regexp_replace(text, '^\s+|\s+$', '', 'g') AS content, source AS workspace_id,
       CASE WHEN doc_id % 11 <> 0 THEN 'u' || (doc_id % 7) END AS user_id,
       CASE WHEN n_chars < 120 THEN 'error' WHEN doc_id % 37 = 5 THEN 'processing' ELSE 'ready' END AS status,
       n_chars AS file_size, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at
FROM documents""")
view("v_workspaces", r"""
SELECT source AS id, 'u' || (CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 7) AS user_id
FROM (SELECT DISTINCT source FROM documents)""")
view("v_queries", r"""
SELECT item_id AS query_id, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
       '([.!?])\s+', '\1' || chr(30), 'g'), chr(30))[1] AS text FROM benchmark""")
view("v_messages", r"""
SELECT conv_id AS conversation_id, turn, role, coalesce(text, '') AS content,
       TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at FROM conversations""")
view("v_requests", r"""
SELECT event_id, ts, user_id AS client, event_type AS path, value AS latency,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events""")
view("v_query_log", r"""
SELECT event_id, ts, CAST(user_id % 3 AS VARCHAR) AS ns,
       event_type || ' ' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS query FROM events""")
view("v_units", r"""
SELECT document_id, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS units
FROM v_docs WHERE content <> ''""")


def _fold(units: str, target: int) -> str:
    return f"""list_reduce({units}, lambda a, u: CASE WHEN a.has AND a.n + length(u) > {target}
      THEN {{'done': list_append(a.done, a.cur), 'cur': right(a.cur, 300) || ' ' || u, 'has': true,
             'n': length(right(a.cur, 300)) + length(u) + 1}}
      ELSE {{'done': a.done, 'cur': CASE WHEN a.has THEN a.cur || ' ' || u ELSE u END, 'has': true,
             'n': a.n + length(u) + 1}} END,
      {{'done': []::VARCHAR[], 'cur': '', 'has': false, 'n': 0::BIGINT}})"""


view("v_folds", f"""
SELECT document_id, 'small' AS granularity, {_fold('units', 1200)} AS f FROM v_units
UNION ALL SELECT document_id, 'large', {_fold('units', 2800)} FROM v_units""")
view("v_chunks_raw", r"""
SELECT document_id, granularity, document_id || '-' || granularity[1] || '-' || (i - 1) AS chunk_id,
       CAST(i - 1 AS INT) AS chunk_index, content, CAST(length(content) // 4 AS INT) AS token_count
FROM (SELECT document_id, granularity, unnest(list_append(f.done, f.cur)) AS content,
             generate_subscripts(list_append(f.done, f.cur), 1) AS i FROM v_folds)
WHERE regexp_replace(content, '\s+', '', 'g') <> ''""")
view("v_chunk_stats", r"""
SELECT *, length(regexp_replace(content, '[^\p{L}\p{N}]', '', 'g')) / greatest(length(content), 1) AS alnum,
       len(list_distinct(w)) / greatest(len(w), 1) AS uniq, sha256(content) AS content_hash
FROM (SELECT *, list_filter(string_split_regex(lower(content), '\s+'),
             lambda x: regexp_full_match(x, '[\p{L}\p{N}]+')) AS w FROM v_chunks_raw)""")
view("v_scored", r"""
SELECT document_id, granularity, chunk_id, chunk_index, content, token_count, content_hash, alnum, uniq,
       CASE WHEN token_count <= 0 THEN 0.0 ELSE token_count * alnum * uniq END AS score,
       token_count BETWEEN 30 AND 1200 AND alnum >= 0.6 AND uniq >= 0.25 AS keep FROM v_chunk_stats""")
view("v_deduped", r"""
SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY granularity DESC, chunk_index) - 1 AS INT) AS position
FROM (SELECT * FROM v_scored WHERE keep
      QUALIFY row_number() OVER (PARTITION BY document_id, content_hash ORDER BY granularity DESC, chunk_index) = 1)""")
view("v_picks", r"""
SELECT document_id, list_reduce(walk[1:greatest(1, CAST(floor(len(walk) * 0.4::DOUBLE) AS BIGINT))],
         lambda a, r: CASE WHEN a.used + r.t <= budget
           THEN {'used': a.used + r.t, 'ids': list_append(a.ids, r.id)} ELSE a END,
         {'used': 0::BIGINT, 'ids': []::VARCHAR[]}).ids AS ids
FROM (SELECT document_id, list({'id': chunk_id, 't': CAST(token_count AS BIGINT)} ORDER BY score DESC, position) AS walk,
             greatest(12000, least(CAST(floor(sum(token_count) * 0.5) AS BIGINT), 30000)) AS budget
      FROM v_deduped GROUP BY document_id)""")
view("v_chunks", r"""
SELECT d.*, list_contains(p.ids, d.chunk_id) AS selected FROM v_deduped d JOIN v_picks p USING (document_id)""")
view("v_figures", r"""
SELECT 'p' || page_id AS document_id, 'p' || page_id || '-f' AS chunk_id, '[Figure] ' || label AS content,
       CAST(greatest(length('[Figure] ' || label) // 4, 1) AS INT) AS token_count, label AS caption
FROM (SELECT page_id, CASE WHEN title <> '' THEN title ELSE 'Figure on page ' || page_id END AS label
      FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS title
            FROM pages))""")
view("v_corpus", r"""
SELECT c.chunk_id, c.document_id, d.workspace_id, d.user_id, c.content, c.token_count, 'text' AS chunk_type,
       NULL::VARCHAR AS caption, true AS selected
FROM v_chunks c JOIN v_docs d ON c.document_id = d.document_id AND d.status = 'ready'
UNION ALL SELECT chunk_id, document_id, 'web', NULL, content, token_count, 'figure', caption, true FROM v_figures""")


def _sparse(source: str, key: str, text: str, dim: int = vec.DENSE_DIM) -> str:
    """Signed slot counts of each text as rows (key, i, w)."""
    slot = "CAST('0x' || substr(h, {a}, 8) AS BIGINT) % {d}"
    sign = "CASE WHEN CAST('0x' || substr(h, {a}, 2) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END"
    slots = ", ".join(
        "{{'i': {0}, 's': {1}}}".format(slot.format(a=a, d=dim), sign.format(a=a)) for a in (1, 9, 17, 25)
    )
    return f"""
SELECT {key}, s.i AS i, sum(s.s * tf) AS w FROM (
  SELECT {key}, tf, unnest([{slots}]) AS s FROM (
    SELECT {key}, tok, count(*) AS tf, sha256(tok) AS h FROM (
      SELECT {key}, unnest(CASE WHEN len(toks) = 0 THEN ['empty'] ELSE toks END) AS tok
      FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS toks FROM {source}))
    GROUP BY ALL))
GROUP BY ALL"""


view("v_qvec", _sparse("v_queries", "query_id", "text"))
view("v_dense", _sparse("(SELECT * FROM v_corpus WHERE selected)", "chunk_id", "content"))
view("v_visual", _sparse("(SELECT * FROM v_corpus WHERE chunk_type = 'figure')", "chunk_id", "caption || ' ' || content"))


def cosine_sql(queries: str, vectors: str) -> str:
    return f"""
SELECT query_id, chunk_id, round(coalesce(s, 0) / (qn * cn), 6) + 0.0 AS score
FROM (SELECT query_id, sqrt(sum(w * w)) AS qn FROM {queries} GROUP BY ALL)
CROSS JOIN (SELECT chunk_id, sqrt(sum(w * w)) AS cn FROM {vectors} GROUP BY ALL)
LEFT JOIN (SELECT q.query_id, c.chunk_id, sum(q.w * c.w) AS s FROM {queries} q JOIN {vectors} c USING (i) GROUP BY ALL)
  USING (query_id, chunk_id)
WHERE qn > 0 AND cn > 0"""


view("v_cos", cosine_sql("v_qvec", "v_dense"))
view("v_vcos", cosine_sql("v_qvec", "v_visual"))
sparse_sql = _sparse
