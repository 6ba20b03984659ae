"""Approximate nearest neighbours on robust-pruned directed graphs, one graph for each shard.

Vectors are dealt into shards by a hash of their id. In a shard, points are inserted in batches: a greedy beam search
from the medoid proposes neighbours, relaxed distance pruning keeps an edge only if no kept neighbour is closer to its
target by the factor `alpha`, and reverse edges are pruned the same way. A query runs a beam search in every shard; what
it finds is scored in double precision on the original vectors and merged.

Equal vectors are one node: a node carries the smallest ids of its class, as many as a query can return, so a vector
with very many copies neither grows a shard nor crowds a graph. A shard holds at most about `shard_rows` nodes and a
search task one shard and `block_rows` queries; more rows make more shards and blocks, not larger tasks.

Defined cases: a vector that is null, zero, or holds null or non-finite components takes no part, neither does one of
another length than most (of lengths equally frequent, the largest counts); repeated rows count once; ties go to the
smaller id; a query with fewer candidates than `k` gets all of them; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.llm.common import read_table, store
from lodestone.session import ship_package

DEGREE, BUILD_BEAM, ALPHA, WIDTH = 32, 64, 1.2, 4


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row's points (ids, -1 for none) to the row's query."""
    diff = x[ids] - q[:, None, :]
    return np.where(ids < 0, np.inf, np.einsum("bcd,bcd->bc", diff, diff))


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest `beam` points found for each query, nearest first, and their squared distances; -1 and inf for none."""
    b = len(queries)
    ids = np.full((b, beam), -1, np.int64)
    ids[:, 0] = start
    dist = _distances(x, ids, queries)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, len(x)), bool)
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        pick = np.argpartition(open_, min(WIDTH, beam - 1), axis=1)[:, :WIDTH] if beam > WIDTH else np.argsort(open_, axis=1)
        usable = np.isfinite(np.take_along_axis(open_, pick, 1))
        go = usable.any(axis=1)
        live, pick, usable = live[go], pick[go], usable[go]
        if not len(live):
            break
        sources = np.where(usable, np.take_along_axis(ids[live], pick, 1), -1)
        marked = done[live]
        np.put_along_axis(marked, pick, True, 1)
        done[live] = marked
        near = np.where((sources < 0)[:, :, None], -1, graph[sources]).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near] & (near >= 0)] = -1
        rows, cols = np.nonzero(near >= 0)
        seen[live[rows], near[rows, cols]] = True
        both = np.concatenate([ids[live], near], axis=1)
        far = np.concatenate([dist[live], _distances(x, near, queries[live])], axis=1)
        flags = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(both, order, 1)
        dist[live] = np.take_along_axis(far, order, 1)
        done[live] = np.take_along_axis(flags, order, 1)
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to DEGREE kept candidates of each point (-1 for none): nearest first, each drops those it is closer to by ALPHA."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates.sort(axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    dist = _distances(x, candidates, x[points])
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    v = x[candidates]
    norms = np.einsum("bcd,bcd->bc", v, v)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, rows = np.isfinite(dist), np.arange(len(points))
    kept = np.full((len(points), DEGREE), -1, np.int64)
    for k in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, k] = candidates[rows[some], first[some]]
        alive &= ~(some[:, None] & (ALPHA * ALPHA * between[rows, first] <= dist))
        alive[rows[some], first[some]] = False
    return kept


def build_graph(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, int]:
    """Out-edges of every point (-1 for none) and the point where searches start."""
    n = len(x)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, DEGREE), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        batch = order[at : at + size]
        at, size = at + size, min(256, size * 2)
        found, _ = beam_search(x, graph, start, x[batch], min(BUILD_BEAM, n))
        graph[batch] = robust_prune(x, batch, found)
        sources, targets = np.repeat(batch, DEGREE), graph[batch].ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by = np.argsort(targets, kind="stable")
        heads, begin, count = np.unique(targets[by], return_index=True, return_counts=True)
        for i in range(0, len(heads), 256):
            some, width = heads[i : i + 256], int(count[i : i + 256].max())
            extra = np.full((len(some), width), -1, np.int64)
            for r, (b, c) in enumerate(zip(begin[i : i + 256], count[i : i + 256])):
                extra[r, :c] = sources[by[b : b + c]]
            graph[some] = robust_prune(x, some, np.concatenate([graph[some], extra], axis=1))
    return graph, start


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: rows that take part, once each."""
    v = F.col("v")
    good = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    good = good.filter(finite & F.exists(v, lambda e: e != 0))
    size = good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return good.filter(F.size("v") == (size["size"] if size else 0)).distinct()


def build_index(vectors: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, int]:
    """Stored graphs: shard, node, start, ids (smallest of the class), v, near; and the number of shards."""
    first = Window.partitionBy("v").orderBy("id")
    classes = vectors.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = store(classes, "classes")
    shards = max(1, math.ceil(classes.count() / shard_rows))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(low=[int(i[0]) for i in pdf["ids"]]).sort_values("low", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
        graph, start = build_graph(x)
        return pd.DataFrame({"shard": key[0], "node": np.arange(len(x)), "start": start, "ids": pdf["ids"], "v": pdf["v"], "near": list(graph.astype(np.int32))})

    ship_package(vectors.sparkSession)
    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
    graphs = dealt.groupBy("shard").applyInPandas(build, f"shard int, node int, start int, ids array<long>, v {kind}, near array<int>")
    return store(graphs, "graphs"), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, beam: int = 128, shard_rows: int = 8192, block_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the `k` nearest found. Both inputs have id, v as from `valid_vectors`."""
    index, shards = build_index(vectors, k, shard_rows)
    blocks = max(1, math.ceil(queries.count() / block_rows))

    def search(key, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(points) or not len(asked):
            return none
        points = points.sort_values("node", ignore_index=True)
        exact = np.stack(points["v"].to_numpy()).astype(np.float64)
        x, graph = exact.astype(np.float32), np.stack(points["near"].to_numpy()).astype(np.int64)
        members, out = points["ids"].to_list(), []
        for i in range(0, len(asked), 256):
            some = asked.iloc[i : i + 256]
            wanted = np.stack(some["v"].to_numpy()).astype(np.float64)
            if len(x) <= beam:
                found = np.broadcast_to(np.arange(len(x)), (len(some), len(x)))
            else:
                found, _ = beam_search(x, graph, int(points["start"][0]), wanted.astype(np.float32), beam)
            for query, own, near in zip(some["id"].tolist(), wanted, found):
                near = near[near >= 0]
                dist = np.sqrt(((exact[near] - own) ** 2).sum(axis=1))
                reach = np.sort(dist)[: k + 1][-1]
                rows = [(d, v) for d, p in zip(dist.tolist(), near.tolist()) if d <= reach for v in members[p] if v != query]
                out += [(query, v, d) for d, v in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else none

    ship_package(vectors.sparkSession)
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    held = index.select("shard", each_block, "node", "start", "ids", "v", "near").groupBy("shard", "block")
    asked = queries.select(each_shard, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v").groupBy("shard", "block")
    found = held.cogroup(asked).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = store(valid_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return nearest(vectors, vectors.filter("id % 100 = 0"))


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLES: dict[str, str] = {}
