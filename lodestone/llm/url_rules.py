"""URL filter: sort-merge range join of reversed-host keys with rule intervals.

A host is turned into a key of its labels in reverse, each closed by a separator, so that a host and all its
subdomains are one interval of keys. Rules and pages are dealt into key ranges, sorted together, and a sweep
keeps the stack of rule hosts whose intervals are open. A page is tested against the path prefixes of that stack only.

A rule fits its host and all subdomains if the path of the URL starts with the rule's path. The rule longest in
host plus path wins, then the longer host; of equal rules with different verdicts `block` wins.

Defined cases: null URL or no `://`: host and path are empty and no rule can fit, unless a rule has an empty host
(an empty host fits only an empty host). Repeated rows each get a row. An empty table gives no rows; without
rules every page gets the default. Rules with a null host, path or verdict are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.common import map_arrow, read_table, slices

END, AFTER = "\x01", "\x02"  # closes a label; the first string after all that start with a closed label
SAMPLE_PER_RANGE = 20


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.encode().lower().decode(), rest[:end]


def host_key(host: str) -> str:
    return "".join(label + END for label in reversed(host.split(".")))


def _order(key: str, path: str, tie: int) -> str:
    return f"{key}\x00{path}\x00{tie & 0xFFFFFFFFFFFFFFFF:016x}"


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (host and path; null if none fits), verdict.

    `rules` has host, path, verdict. Both sides may be of any size: a rule is copied only to the key ranges that its
    interval meets, and URLs that repeat very often are spread by a hash of the id, which is part of the sort key.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(F.col(id_col), F.col(url_col)).alias("tie"))
    sample = own.orderBy("tie").limit(SAMPLE_PER_RANGE * n).collect()  # only balances the ranges
    keys = sorted(_order(host_key(h), p, r.tie) for r in sample for h, p in [split_url(r.url)])
    bounds = [keys[i * len(keys) // n] for i in range(1, n)] if keys else []

    def parse(batches):
        for batch in slices(batches, 20_000):
            urls, ties = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            parts = [split_url(u) for u in urls]
            order = [_order(host_key(h), p, t) for (h, p), t in zip(parts, ties)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bisect_right(bounds, o) for o in order], pa.int32()), pa.array(order, pa.string()), pa.array([1] * len(order), pa.int32()),
                    batch.column(0).cast(pa.string()), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                    pa.nulls(len(order), pa.string()),
                ],
                names=["range", "order", "kind", "id", "host", "path", "verdict"],
            )

    def spread(batches):
        for batch in batches:
            rows = []
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                key = host_key(host)
                low, high = bisect_right(bounds, key), bisect_right(bounds, key[:-1] + AFTER)
                rows += [(r, key, 0, None, host, path, verdict) for r in range(low, high + 1)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "order", "kind", "id", "host", "path", "verdict"])

    def sweep(batches):
        here, stack = None, []  # stack: (key, host, {path: verdict}, path lengths)
        for batch in slices(batches, 20_000):
            kept = []
            for rng, order, kind, ident, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if rng != here:
                    here, stack = rng, []
                while stack and not order.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != order:
                        stack.append((order, host, {}, set()))
                    known = stack[-1][2]
                    stack[-1][3].add(len(path))
                    known[path] = "block" if "block" in (verdict, known.get(path)) else verdict
                    continue
                best = None
                for _, rule_host, paths, sizes in stack:
                    if not (host == rule_host or rule_host and host.endswith("." + rule_host)):
                        continue
                    for size in sizes:
                        if size <= len(path) and path[:size] in paths:
                            found = (len(rule_host) + size, len(rule_host), rule_host + path[:size], paths[path[:size]])
                            best = max(best or found, found)
                kept.append((ident, host, path, best and best[2], best[3] if best else default))
            columns = list(zip(*kept)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", "host", "path", "rule", "verdict"])

    schema = "range int, order string, kind int, id string, host string, path string, verdict string"
    valid = rules.select("host", "path", "verdict").dropna()
    events = map_arrow(own, parse, schema).unionByName(map_arrow(valid, spread, schema))
    dealt = events.repartition(n, "range").sortWithinPartitions("range", "order", "kind")
    judged = map_arrow(dealt, sweep, "id string, host string, path string, rule string, verdict string")
    return judged.withColumn("id", F.col("id").cast(pages.schema[id_col].dataType)).withColumnRenamed("id", id_col)


#: Production rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(read_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages),
cut AS (SELECT n, page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest),
parts AS (SELECT n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut),
fits AS (
  SELECT p.n, p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

QUERIES = {"op10_url_rules": op10_url_rules}
ORACLES = {"op10_url_rules": SQL}
