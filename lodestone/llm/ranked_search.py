"""Ranked lexical search for a table of items by dual trees of coordinate maxima.

A document's terms weigh by a saturating whole-number impact, an item's by how rare they are, so a score is an inner
product of two sparse vectors without negative parts. Both sides are put into hierarchies whose nodes hold the largest
weight of each term below them; the product of two nodes is then no less than any score between them. Pairs of nodes
are followed from the top, all pairs of a level at once, and a pair is dropped with everything below it where its bound
is under the weakest k-th score that its items have so far. What reaches the leaves is scored exactly.

The term counts of documents, for terms of items only, are written once. Items are ordered by their commonest terms and
cut into blocks of bounded size that go to every task; documents stay where they lie, in batches ordered by the items
they are nearest to. Shares of the documents are searched one after the other, small ones first: their k-th scores are
a floor for all tasks of the next, so that later tasks prune early and return few rows. Every share is searched in
full, and equal scores are never dropped, so results are exact.

Defined cases: null or term-free texts have no terms and are not counted; repeated documents each have a place, and a
repeated item gives its rows again; documents with a null id count in the statistics but are not returned; an item
without terms gives no rows; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.llm.common import map_arrow, ranges, read_table, slices, store

#: ASCII letters and digits in lower case and all other bytes from 0x80 stay, the rest separates.
TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
FANOUT_ITEMS, FANOUT_DOCS = 4, 4
BATCH_DOCS, BATCH_TERMS = 2048, 1 << 20


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


@dataclass
class Rows:
    """Sparse rows: row r has terms[at[r]:at[r + 1]] with `weight`."""

    at: np.ndarray
    terms: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of these rows, one after the other, and how many each row has."""
        counts = self.at[rows + 1] - self.at[rows]
        return np.repeat(self.at[rows], counts) + ranges(counts), counts

    def take(self, rows: np.ndarray) -> Rows:
        where, counts = self.places(rows)
        return Rows(np.concatenate([[0], np.cumsum(counts)]), self.terms[where], self.weight[where])

    def maxima(self, fanout: int) -> Rows:
        """Rows of nodes of `fanout` neighbouring rows each, with the largest weight of every term."""
        nodes = -(-len(self) // fanout)
        node = np.repeat(np.arange(len(self)) // fanout, np.diff(self.at))
        order = np.lexsort((self.terms, node))
        node, terms, weight = node[order], self.terms[order], self.weight[order]
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (terms[1:] != terms[:-1])])) if len(node) else np.empty(0, np.int64)
        top = np.maximum.reduceat(weight, first) if len(first) else weight
        return Rows(np.searchsorted(node[first], np.arange(nodes + 1)), terms[first], top)

    def dots(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner products of these rows with a dense vector."""
        where, counts = self.places(rows)
        sums = np.concatenate([[0], np.cumsum(dense[self.terms[where]] * self.weight[where])])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]


def tree(rows: Rows, fanout: int, top: int) -> list[Rows]:
    """Levels from the top, with at most `top` nodes, down to the rows themselves."""
    levels = [rows]
    while len(levels[0]) > top:
        levels.insert(0, levels[0].maxima(fanout))
    return levels


class Found:
    """The k first documents of every item so far, and the score that a further one must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(floor)

    def add(self, item: int, scores: np.ndarray, names: np.ndarray) -> None:
        good = scores >= max(self.floor[item], 1)
        scores, names = np.concatenate([self.best[item][0], scores[good]]), np.concatenate([self.best[item][1], names[good]])
        order = np.lexsort((names, -scores))[: self.k]
        self.best[item] = scores[order], names[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], scores[order[-1]])


def follow(items: list[Rows], docs: list[Rows], names: np.ndarray, found: Found, size: int) -> int:
    """Compare both trees from the top; returns how many documents were scored against an item."""
    scored, dense = 0, np.zeros(size, np.int64)
    pairs = [np.arange(len(docs[0]))] * len(items[0])
    for level in range(max(len(items), len(docs))):
        side, rows = items[min(level, len(items) - 1)], docs[min(level, len(docs) - 1)]
        last = level == max(len(items), len(docs)) - 1
        below = FANOUT_ITEMS ** max(0, len(items) - 1 - level)
        kept = []
        for i, nodes in enumerate(pairs):
            if len(nodes):
                a, b = side.at[i], side.at[i + 1]
                dense[side.terms[a:b]] = side.weight[a:b]
                bounds = rows.dots(nodes, dense)
                dense[side.terms[a:b]] = 0
                if last:
                    scored += len(nodes)
                    found.add(i, bounds, names[nodes])
                else:
                    nodes = nodes[bounds >= max(1, found.floor[i * below : (i + 1) * below].min())]
            kept.append(nodes)
        if last:
            break
        if level < len(docs) - 1:
            kept = [(n[:, None] * FANOUT_DOCS + np.arange(FANOUT_DOCS)).ravel() for n in kept]
            kept = [n[n < len(docs[level + 1])] for n in kept]
        if level < len(items) - 1:
            kept = [n for n in kept for _ in range(FANOUT_ITEMS)][: len(items[level + 1])]
        pairs = kept
    return scored


@dataclass
class Block:
    """A bounded set of items: ids, the tree of their terms' weights, and the corpus statistics that impacts need."""

    ids: np.ndarray
    levels: list[Rows]
    size: int
    n: int
    total: int

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 25 + 25 * n.astype(np.int64) * self.n // self.total
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def item_block(rows: list, vocabulary: dict, df: np.ndarray, n: int, total: int) -> Block:
    """The tree of items (id, terms), ordered by their commonest terms."""
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1.0))).astype(np.int64)
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    known = [sorted((place[t], t, c) for t, c in Counter(vocabulary[w] for w in words).items()) for _, words in rows]
    order = sorted(range(len(rows)), key=lambda i: [p for p, _, _ in known[i]])
    at = np.concatenate([[0], np.cumsum([len(known[i]) for i in order])])
    terms = np.array([t for i in order for _, t, _ in known[i]], np.int64)
    counts = np.array([c for i in order for _, _, c in known[i]], np.int64)
    leaves = Rows(at, terms, counts * weight[terms])
    return Block(np.array([rows[i][0] for i in order], np.int64), tree(leaves, FANOUT_ITEMS, 16), len(df), n, total)


def _nearest_first(block: Block, docs: Rows) -> np.ndarray:
    """Documents by the group of items whose bound is highest for them, high bounds first."""
    top, everything = block.levels[0], np.arange(len(docs))
    bounds = np.zeros((len(top), len(docs)), np.int64)
    for i in range(len(top)):
        dense = np.zeros(block.size, np.int64)
        dense[top.terms[top.at[i] : top.at[i + 1]]] = top.weight[top.at[i] : top.at[i + 1]]
        bounds[i] = docs.dots(everything, dense)
    return np.lexsort((-bounds.max(axis=0), bounds.argmax(axis=0)))


def _search(block: Block, floor: np.ndarray, k: int):
    """Function over batches of (id, n, terms, tf): each item's k first documents of the task."""

    def parts(batches):
        for batch in slices(batches, BATCH_DOCS):
            ends = batch.column(2).offsets.to_numpy()
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BATCH_TERMS)) - 1)
                yield batch.slice(start, stop - start)
                start = stop

    def run(batches):
        found = Found(floor, k)
        for part in parts(batches):
            n = part.column(1).to_numpy()
            at = np.concatenate([[0], np.cumsum(np.diff(part.column(2).offsets.to_numpy()))])
            tf = part.column(3).flatten().to_numpy().astype(np.int64)
            docs = Rows(at, part.column(2).flatten().to_numpy(), block.impacts(tf, np.repeat(n, np.diff(at))))
            order = _nearest_first(block, docs)
            follow(block.levels, tree(docs.take(order), FANOUT_DOCS, 64), part.column(0).to_numpy()[order], found, block.size)
        sizes = [len(s) for s, _ in found.best]
        place = np.repeat(np.arange(len(sizes)), sizes)
        scores = np.concatenate([s for s, _ in found.best] or [np.empty(0, np.int64)])
        names = np.concatenate([d for _, d in found.best] or [np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(block.ids[place]), pa.array(names), pa.array(scores)], names=["place", "item_id", "doc_id", "score"])

    return run


def term_vectors(docs: DataFrame, vocabulary: dict, shares: tuple[int, ...], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the text), terms and tf (those in the vocabulary), share: stored by share."""

    def run(batches):
        get = vocabulary.get
        for batch in slices(batches, 500):
            n, terms, counts = [], [], []
            for v in batch.column(1):
                words = terms_of(v.as_py())
                seen = Counter(map(get, words))
                seen.pop(None, None)
                n.append(len(words))
                terms.append(np.fromiter(seen, np.int32, len(seen)))
                counts.append(np.fromiter(seen.values(), np.int32, len(seen)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), batch.column(2)], names=["id", "n", "terms", "tf", "share"]
            )

    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(shares[-1]))
    share = F.lit(len(shares) - 1)
    for i in reversed(range(len(shares) - 1)):
        share = F.when(draw < shares[i], i).otherwise(share)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), share.alias("share"))
    return store(map_arrow(own, run, "id long, n long, terms array<int>, tf array<int>, share int"), "terms")


def _search_block(docs: DataFrame, items: DataFrame, k: int, shares: tuple[int, ...], id_col: str, text_col: str) -> DataFrame | None:
    rows = [(r["id"], terms_of(r["text"])) for r in items.orderBy("id", "text").collect()]
    rows = [r for r in rows if r[1]]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in rows for w in words}))}
    if not vocabulary:
        return None
    vectors = term_vectors(docs, vocabulary, shares, id_col, text_col)
    seen = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("total")).first()
    if not seen["total"]:
        return None
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counted["t"].to_numpy()] = counted["count"].to_numpy()
    block = item_block(rows, vocabulary, df, seen["n"], seen["total"])
    floor, found = np.zeros(len(block.ids), np.int64), None
    for share in range(len(shares)):
        part = vectors.filter((F.col("share") == share) & F.col("id").isNotNull() & (F.size("terms") > 0)).select("id", "n", "terms", "tf")
        new = map_arrow(part, _search(block, floor, k), "place long, item_id long, doc_id long, score long")
        found = new if found is None else found.unionByName(new)
        order = Window.partitionBy("place").orderBy(F.desc("score"), "doc_id")
        found = store(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "ranked")
        weakest = found.groupBy("place").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k).toArrow()
        floor[weakest["place"].to_numpy()] = weakest["low"].to_numpy()
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = 2_000_000, shares: tuple[int, ...] = (1, 32, 1024)) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `k` documents of the highest scores above 0.

    `block_terms` bounds the terms of the items that are searched together and shipped to tasks; `shares` are the parts
    of the documents, of the last number, that have been searched after each turn.
    """
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks, out = max(1, math.ceil(size / 2 / block_terms)), None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        found = _search_block(docs, part, k, shares, id_col, text_col)
        if found is not None:
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "doc_id")))
            found = found.select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_ranked": op11_ranked}
_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "op11_ranked": f"""
WITH d AS MATERIALIZED (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
p AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) GROUP BY ALL),
i AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS t FROM benchmark) GROUP BY ALL),
c AS (SELECT count(*) AS total_docs, CAST(sum(n) AS BIGINT) AS total_terms FROM d),
v AS (SELECT t, CAST(floor(1000 * ln((2 * total_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (SELECT item_id, doc_id, CAST(sum(q * v.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total_docs) // total_terms)))) AS BIGINT) AS score
      FROM i JOIN p USING (t) JOIN v USING (t), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= 20"""
}
