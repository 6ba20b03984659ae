"""Hard negatives by exact integer scores in residue arithmetic.

Components are whole numbers. An inner product is computed modulo several primes below 1024, each by a float32 matrix
product of balanced residues, which is exact as long as no sum passes 2^24; Chinese remaindering then gives the exact
signed score. The number of primes follows from the largest component of the data.

Rows are packed into chunks of bounded size, chunks into groups and anchors into blocks; every (group, block) is one
cogroup, so the work is split along both sides and a task holds one group and one block. A first pass finds each
anchor's positives, a second its negatives in the windows that the positives set. A task returns at most k rows for an
anchor and window. Nothing is split by label, so a label with most of the rows makes no larger task.

Defined cases: rows with a null id, label or vector, a null or non-finite component, no components, or another number
of components than most rows take no part; a vec_id that several rows have is one anchor, of the smallest (label,
vector), and is never its own positive or negative, but each of its rows counts for other anchors; an anchor without
positives or a window without rows gives no rows; scores beyond 64 bits raise an error; empty tables give no rows;
only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestone.llm.common import map_arrow, read_table, slices, store

CHUNK = 4096
#: Anchors of one matrix product.
TILE = 512
NONE = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """Primes from 1021 downwards whose product exceeds twice the bound."""
    found, product, n = [], 1, 1023
    while product <= 2 * bound + 1:
        if all(n % d for d in range(2, math.isqrt(n) + 1)):
            found.append(n)
            product *= n
        n -= 2
    return found


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Whole float32 numbers below 2^24 to their residues nearest to zero; the quotient may be off by one, so twice."""
    f = np.float32(p)
    for _ in range(2):
        x = x - f * np.rint(x / f)
    return x


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """float32 residues of an int64 matrix, in -(p-1)/2 .. (p-1)/2."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p of balanced residues: float32 products of as many columns as stay below 2^24."""
    step = max(1, (1 << 24) // (p // 2) ** 2 - 1) if a.shape[1] * (p // 2) ** 2 >= 1 << 24 else max(1, a.shape[1])
    total = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, a.shape[1], step):
        total = _balanced(total + _balanced(a[:, i : i + step] @ b[:, i : i + step].T, p), p)
    return total


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The int64 numbers nearest to zero with these balanced residues, by mixed radix digits."""
    digits: list[np.ndarray] = []
    for k, (part, p) in enumerate(zip(parts, primes)):
        d = part
        for j in range(k):
            d = _balanced(_balanced(d - digits[j], p) * np.float32(pow(primes[j], -1, p)), p)
        digits.append(d)
    total = np.zeros(parts[0].shape, np.int64)
    for d, p in zip(reversed(digits), reversed(primes)):
        total = total * p + d.astype(np.int64)
    return total


def score_matrix(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of rows given by their residues for each prime."""
    return reconstruct([product_mod(x, y, p) for x, y, p in zip(a, b, primes)], primes)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of every row, earlier columns first among equals; NONE never counts."""
    n = scores.shape[1]
    bar = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), NONE)
    row, col = np.nonzero((scores >= bar[:, None]) & (scores != NONE))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _keep(rows: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """Of (slot, score, id) the k first of each slot."""
    slot, score, name = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((name, -score, slot))
    slot, score, name = slot[order], score[order], name[order]
    keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < k
    return [(slot[keep], score[keep], name[keep])]


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """id, label, c (components times `scale`, rounded down) of the rows that take part."""
    own = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = own.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = good.filter(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    size = good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    good = good.filter(F.size("v") == (size["size"] if size else 0))
    return good.select("id", "label", F.transform("v", lambda e: F.floor(e * scale).cast("long")).alias("c"))


def _packed(rows: DataFrame, groups: int) -> DataFrame:
    """g, data: chunks of at most CHUNK rows as Arrow streams, dealt into groups."""

    def run(batches):
        held, n = [], 0

        def chunk():
            table = pa.Table.from_batches(held)
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, table.schema) as writer:
                    writer.write_table(table)
                return pa.RecordBatch.from_arrays([pa.array([table["id"][0].as_py()], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["mark", "data"])

        for batch in batches:
            for part in slices([batch], 512):
                held.append(part)
                n += part.num_rows
                if n + 512 > CHUNK:
                    yield chunk()
                    held, n = [], 0
        if n:
            yield chunk()

    made = map_arrow(rows, run, "mark long, data binary")
    return made.select(F.pmod(F.xxhash64("mark"), F.lit(groups)).cast("int").alias("g"), "data")


def _open(data: pa.ChunkedArray) -> list[pa.Table]:
    return [pa.ipc.open_stream(x.as_py()).read_all() for x in data]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _score_grid(rows: DataFrame, groups: int, anchors: DataFrame, blocks: int, primes: list[int], windows: int, k: int, same_label: bool) -> DataFrame:
    """anchor, slot, id, score: of each anchor and window the first k in each group of rows.

    `anchors` has id, label, c and with `same_label` False low and high, the inclusive bounds of `windows` windows.
    """

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "slot", "id", "score"]
        out = [pa.table([pa.array([], pa.int64())] * 4, names=names)]
        if not left.num_rows or not right.num_rows:
            return out[0]
        chunks = []
        for table in _open(left["data"]):
            ids = table["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            c = _matrix(table["c"])[order]
            chunks.append((ids[order], table["label"].to_numpy()[order], [residues(c, p) for p in primes]))
        asked = pa.concat_tables(_open(right["data"]))
        for i in range(0, asked.num_rows, TILE):
            some = asked.slice(i, TILE)
            own, label, c = some["id"].to_numpy(), some["label"].to_numpy(), _matrix(some["c"])
            lows, highs = ([None], [None]) if same_label else (_matrix(some["low"]).T, _matrix(some["high"]).T)
            parts, held = [residues(c, p) for p in primes], []
            for ids, labels, rest in chunks:
                scores = score_matrix(parts, rest, primes)
                fits = (label[:, None] == labels) if same_label else (label[:, None] != labels)
                scores = np.where(fits & (own[:, None] != ids), scores, NONE)
                for w, (low, high) in enumerate(zip(lows, highs)):
                    inside = scores if same_label else np.where((scores >= low[:, None]) & (scores <= high[:, None]), scores, NONE)
                    row, col = best(inside, k)
                    held.append((row * windows + w, inside[row, col], ids[col]))
                held = _keep(held, k)
            slot, score, name = held[0]
            out.append(pa.table([own[slot // windows], slot % windows, name, score], names=names))
        return pa.concat_tables(out)

    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    held = _packed(rows, groups).select("g", each_block, "data").groupBy("g", "b")
    asked = _packed(anchors, blocks).withColumnRenamed("g", "b").select(each_group, "b", "data").groupBy("g", "b")
    return held.cogroup(asked).applyInArrow(search, "anchor long, slot long, id long, score long")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, c).

    Negatives of an anchor and positive are the first rows of other labels whose score is from `low` to `high` per cent
    of the positive's.
    """
    rows = store(rows, "whole")
    size = F.transform("c", lambda e: F.abs(e))
    seen = rows.agg(F.count("*").alias("n"), F.max(F.array_max(size)).alias("most"), F.max(F.size("c")).alias("d"), F.count(F.when(is_anchor, 1)).alias("a")).first()
    bound = (seen["d"] or 0) * (seen["most"] or 0) ** 2
    if 100 * bound >= 1 << 63:
        raise ValueError("scores pass 64 bits: use a smaller scale")
    primes = primes_for(bound)
    groups = max(1, math.ceil(seen["n"] / min(262_144, max(8192, seen["n"] // 64))))
    blocks = max(1, math.ceil(seen["a"] / block_rows))
    anchors = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "c")).alias("r")).select("id", "r.label", "r.c")
    anchors = store(anchors, "anchors")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = _score_grid(rows, groups, anchors, blocks, primes, 1, positives, True)
    near = near.withColumn("p", F.row_number().over(first)).filter(F.col("p") <= positives)
    near = store(near.select("anchor", (F.col("p") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    bounds = near.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "positive_score"))).alias("m"))

    def edges(per_cent: int, up: bool) -> Column:
        """One bound for each slot; a missing positive has an empty window, from 1 to 0."""
        slots = F.sequence(F.lit(0).cast("long"), F.lit(positives - 1).cast("long"))
        return F.transform(slots, lambda i: F.coalesce(_divided(F.try_element_at("m", i) * per_cent, up), F.lit(int(up)).cast("long")))

    asked = anchors.join(bounds.select(F.col("anchor").alias("id"), edges(low, True).alias("low"), edges(high, False).alias("high")), "id")
    found = _score_grid(rows, groups, store(asked, "windows"), blocks, primes, positives, negatives, False)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.join(near, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _divided(x: Column, up: bool) -> Column:
    """x / 100 in whole numbers, rounded up or down."""
    rest = F.pmod(x, F.lit(100).cast("long"))
    down = F.call_function("div", x - rest, F.lit(100).cast("long"))
    return F.when(rest > 0, down + 1).otherwise(down) if up else down


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(table, "vec_id", "embedding", label, 256)
    return mine(rows, F.pmod(F.col("id"), F.lit(100)) == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES: dict[str, str] = {
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS c
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
      FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10"""
}
