"""Line dedup by site-relative frequency.

Within a host, the pages that hold a line are divided by the pages of the host; lines above a ratio are boilerplate
and are dropped from every page of that host. Lines are compared without surrounding white space.

The lines of a host above ratio r are at most (mean distinct lines per page) / r, so their list on a host's row is
bounded. Counting is pre-aggregated per host and line; the host's list meets its pages under a salt, so that a host
with a third of all pages is dealt over `salts` keys.

Defined cases: null text counts as a page without lines and stays null; blank lines are kept and never counted; a null
host is a host of its own, the same as the empty name; repeated rows are pages of their own; other columns, whatever
their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.common import numbered, read_table

SPACES = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def _codes(lines: Column) -> Column:
    """Each line as two independent 64-bit hashes."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, text_col: str, host_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """host, lines: per host the codes of its lines on more than `max_ratio` of its pages, and on `min_pages` at least."""
    own = pages.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    distinct = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda x: x != ""))
    seen = own.select("host", F.explode(_codes(distinct)).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    high = counts.join(totals, "host").filter(F.col("n") > F.col("pages") * max_ratio)
    return high.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_lines(pages: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.1, min_pages: int = 5, salts: int = 32, name: str = "_lines") -> DataFrame:
    """`pages` with `text_col` freed of boilerplate lines, and a struct `name` of (total, dropped) as last column."""
    rules = boilerplate(pages, text_col, host_col, max_ratio, min_pages)
    rules = rules.select(F.col("host").alias("_host"), F.col("lines").alias("_rules"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    text, host = (F.col(f"c{pages.columns.index(c)}") for c in (text_col, host_col))
    held = numbered(pages).withColumns({"_host": F.coalesce(host.cast("string"), F.lit("")), "_salt": F.pmod(F.xxhash64(text), F.lit(salts)).cast("int")})
    joined = held.join(rules, ["_host", "_salt"], "left")
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("_rules"), _codes(F.array(_trimmed(x)))[0]))
    cut = joined.withColumn("_kept", F.when(F.col("_rules").isNull(), _lines(text)).otherwise(kept))
    total, left = (F.coalesce(F.size(c), F.lit(0)).cast("long") for c in (_lines(text), F.col("_kept")))
    columns = [(F.array_join("_kept", "\n") if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(pages.columns)]
    return cut.select(*columns, F.struct(total.alias("total"), (total - left).alias("dropped")).alias(name))


def op7_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines and the SHA-256 of what is kept; the source is the host."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = drop_lines(docs)
    return out.select("doc_id", "source", F.col("_lines.total").alias("n_lines"), F.col("_lines.dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


#: Lines of a document with their number and trimmed form; boilerplate as above. Shared with the pipeline's check.
SQL = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text, source, coalesce(source, '') AS host FROM documents),
l AS (SELECT n, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
t AS (SELECT n, host, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM l),
c AS (SELECT host, s, count(DISTINCT n) AS k FROM t WHERE s <> '' GROUP BY ALL),
b AS (SELECT c.host, c.s FROM c JOIN (SELECT host, count(*) AS pages FROM d GROUP BY ALL) USING (host) WHERE k >= 5 AND k > pages * 0.1),
k AS (
  SELECT t.n, count(*) AS n_lines, count(b.s) AS n_dropped, coalesce(string_agg(t.line, chr(10) ORDER BY t.i) FILTER (WHERE b.s IS NULL), '') AS kept
  FROM t LEFT JOIN b ON t.host = b.host AND t.s = b.s GROUP BY t.n)
SELECT doc_id, source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM d LEFT JOIN k USING (n)
"""

QUERIES = {"op7_site_lines": op7_site_lines}
ORACLES = {"op7_site_lines": SQL}
