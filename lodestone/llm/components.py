"""Connected components of a link table by alternating stars, every round a stored table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import discard, map_arrow, store

#: Links that a task ties together by itself; so few of them need no rounds.
TASK_LINKS = 262_144


def _forest(links: np.ndarray) -> np.ndarray:
    """Links (a, b) with the same components: every node is tied to the smallest that these links reach."""
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(links.shape)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        if (low == np.maximum(root[a], root[b])).all():
            break
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    tied = root != np.arange(len(nodes))
    return np.stack([nodes[root[tied]], nodes[tied]])


def _tied(edges: DataFrame, count: int) -> DataFrame:
    """Links with the same components, tied together within each task, of which there is one for `TASK_LINKS` links.

    A task holds no more than twice so many: a larger forest is handed on and the next one begun.
    """
    most = TASK_LINKS

    def run(batches):
        held, size = [np.empty((2, 0), np.int64)], 0

        def out(links):
            for j in range(0, links.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[j : j + 100_000]) for c in links], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
            size += batch.num_rows
            if size > 2 * most:
                held = [_forest(np.concatenate(held, axis=1))]
                if held[0].shape[1] > most:
                    yield from out(held[0])
                    held = [np.empty((2, 0), np.int64)]
                size = held[0].shape[1]
        yield from out(_forest(np.concatenate(held, axis=1)))

    return map_arrow(edges.select("a", "b").coalesce(1 + count // most), run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node itself, are tied to the smallest of them. Edges have a < b."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
    return moved.filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has a link. `edges` has a and b, longs, in either order.

    Tasks first tie the links together that they hold; at most `TASK_LINKS` links are one task's and done. Of more, rounds of
    stars follow, and end when a round changes nothing; their number grows with the logarithm of the longest chain. A node with
    very many links is a key of partial aggregates and of joins that adaptive execution splits. No links, no rows.
    """
    edges = store(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).filter("a < b").distinct(), "links")
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        few = seen["n"] <= TASK_LINKS
        if (seen["n"], seen["s"]) != mark and seen["n"]:
            mark = (seen["n"], seen["s"])
            tied = _tied(edges, seen["n"])
            before, edges = edges, store(tied if few else _small_star(_large_star(tied)), "links")
            discard(before)
            if not few:
                continue
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
