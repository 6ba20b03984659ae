"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into segments; the bit counts of its segments are a point in a small integer grid. A
differing bit moves one count by one, so the Manhattan distance of two points is a lower bound of the Hamming distance
of their fingerprints. Fingerprints within distance d therefore lie in cells at most d steps apart: a range join over
the grid, by equality, as each point probes the cells in half of the ball around it (the other half finds it in turn).
What meets is verified on the fingerprints.

Exact copies share a fingerprint and are one node. A fingerprint has at most 2080 others within two bits, so links are
bounded by the number of different fingerprints, whatever the size of a group of copies.

Defined cases: null or wordless text has fingerprint zero and is linked like any other; a text with fewer words than a
shingle is one shingle; repeated rows each get a row; a null id is never a component's smallest id; an empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

import gc
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.common import discard, map_arrow, read_table, slices, store
from lodestone.llm.components import components

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the text's shingles in order, repeats included, as unsigned 64-bit numbers."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number whose bits are set where over half the hashes have them set."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (signed 64-bit) of every row."""

    def run(batches):
        for batch in slices(batches, 1000):
            fps = [majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(own, run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _cell(fp: Column, start: int, sizes: list[int]) -> Column:
    """The bit counts of consecutive segments from bit `start` on, four bits for each, as one number."""
    key = F.lit(0).cast("long")
    for i, size in enumerate(sizes):
        part = F.bit_count(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << size) - 1).cast("long"))).cast("long")
        key = key + F.shiftleft(part, 4 * i)
        start += size
    return key


def _half_ball(dims: int, radius: int) -> list[int]:
    """Packed steps of Manhattan length 1 to `radius`, one of each opposite pair."""
    found = set()
    for length in range(1, radius + 1):
        for axes in itertools.combinations_with_replacement(range(dims), length):
            for signs in itertools.product((1, -1), repeat=length):
                step = [0] * dims
                for axis, sign in zip(axes, signs):
                    step[axis] += sign
                first = next((x for x in step if x), 0)
                if first > 0 and sum(map(abs, step)) == length:
                    found.add(sum(x << 4 * i for i, x in enumerate(step)))
    return sorted(found)


def links(fps: DataFrame, distance: int = 2, groups: tuple[tuple[int, ...], ...] = ((8,) * 8,)) -> DataFrame:
    """a, b: pairs of different fingerprints at most `distance` bits apart. `fps` has distinct fp.

    Each group lists the segment sizes of a stretch of bits; of g groups, one has at most distance // g differing bits,
    so that points need to meet in one group only. A pair that meets in several groups appears several times.

    The planner takes the probes for as large as the points they are exploded from and would broadcast them; the hint keeps both sides dealt by cell.
    """
    radius = distance // len(groups)
    homes, probes, start = [], [], 0
    for g, sizes in enumerate(groups):
        home = fps.select(F.lit(g).alias("g"), _cell(F.col("fp"), start, list(sizes)).alias("cell"), F.col("fp").alias("b"))
        steps = F.array(*(F.lit(s).cast("long") for s in [0, *_half_ball(len(sizes), radius)]))
        probe = home.select("g", "cell", F.col("b").alias("a")).select("g", "a", F.explode(steps).alias("step"), "cell")
        homes.append(home)
        probes.append(probe.select("g", (F.col("cell") + F.col("step")).alias("cell"), "a", (F.col("step") == 0).alias("same")))
        start += sum(sizes)
    home, probe = homes[0], probes[0]
    for h, p in zip(homes[1:], probes[1:]):
        home, probe = home.unionByName(h), probe.unionByName(p)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return probe.join(home.hint("merge"), ["g", "cell"]).filter(near & (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """id, fp, component_id (smallest id reachable over links, the row's own included) of every row."""
    marked = store(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = store(marked.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Bits of three groups, in segments of three or four: of at most eight differing bits, one group has two at most.
WIDE_GROUPS = ((3,) * 7, (3,) * 7, (3,) * 6 + (4,))


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """n, shingles: sorted different shingle hashes of the wanted texts (t1, t2, n), one text each."""

    def run(batches):
        for batch in slices(batches, 500):
            found = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["n", "shingles"])

    own = docs.select(*_text_key(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = own.join(wanted, ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("n").alias("n"), F.first("text").alias("text"))
    return map_arrow(met.select("n", "text"), run, "n long, shingles array<long>")


def _text_key(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have that Jaccard similarity at least."""
    met = pairs.join(sets.select(F.col("n").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("n").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.filter(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select("a", "b")


#: Texts sampled for the order of shingles, and the most shingles it names. Any order gives the same result.
SAMPLE, FREQUENT = 20_000, 131_072
#: Rounds against one text of each shingle end when the pairs left are so many times the rows, and after STARS in any case.
PAIRS_A_ROW, STARS = 4, 6


def _frequent(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles, and how many sampled texts have each."""

    def run(batches):
        for batch in slices(batches, 100):
            found = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], names=["s"])

    every = max(1, docs.count() // SAMPLE)
    own = docs.select(F.col(text_col).alias("text")).filter(F.pmod(_text_key(text_col)[0], F.lit(every)) == 0)
    top = map_arrow(own, run, "s long").groupBy("s").agg(F.count("*").alias("c")).filter("c > 2").orderBy(F.desc("c"), "s").limit(FREQUENT).toArrow()
    found, counts = top["s"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(found)
    return found[order], counts[order]


def _prefix(kinds: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: sets as similar as that share one of these at least."""
    if not len(kinds):
        return kinds
    size = len(kinds) - math.ceil(similarity * len(kinds) - 1e-6) + 1
    weight = np.zeros(len(kinds), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, kinds), len(frequent) - 1)
        weight = np.where(frequent[at] == kinds, counts[at], 0)
    return kinds[np.lexsort((kinds, weight))[:size]]


def _released(df: DataFrame, name: str) -> DataFrame:
    """`df` stored; shuffle files of ended steps go now and not when the driver happens to collect its garbage."""
    out = store(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _shared(nodes: DataFrame) -> DataFrame:
    """n, k, i, s: the first shingles (i-th of a text n with k) that several texts have.

    Most first shingles have one text, so they go to their bucket packed, a row for each batch and bucket, and only
    what is shared comes out as rows. A bucket remembers one place of every shingle, however many texts share it.
    """
    names, buckets = ["n", "k", "i", "s"], 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        for batch in batches:
            firsts, size = batch.column(2).flatten().to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            place = np.arange(len(firsts)) - np.repeat(np.cumsum(size) - size, size)
            columns = [np.repeat(batch.column(0).to_numpy(), size), np.repeat(batch.column(1).to_numpy(), size), place, firsts]
            home = ((firsts.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(home, kind="stable")
            found, at = np.unique(home[order], return_index=True)
            ends = pa.array(np.append(at, len(order)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.ListArray.from_arrays(ends, pa.array(c[order].astype(np.int64))) for c in columns)], names=["bucket", *names])

    def meet(batches):
        held, size = [np.empty((5, 0), np.int64)], 0

        def reduced():
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.argsort(rows[3], kind="stable")]
            first = np.concatenate([[True], rows[3, 1:] != rows[3, :-1]])[: rows.shape[1]]
            several = np.bincount(np.cumsum(first) - 1, minlength=1)[np.cumsum(first) - 1] > 1 if rows.shape[1] else first
            out = rows[:4, several & (rows[4] == 0)]
            rows[4] |= several
            held[:] = [rows[:, first]]
            for j in range(0, out.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[j : j + 100_000]) for c in out], names=names)

        for batch in batches:
            columns = [batch.column(c).flatten().to_numpy() for c in names]
            held.append(np.stack([*columns, np.zeros(len(columns[0]), np.int64)]))
            size += len(columns[0])
            if size > 4_000_000:
                yield from reduced()
                size = held[0].shape[1] // 2
        yield from reduced()

    dealt = map_arrow(nodes.select("n", "k", "firsts"), deal, "bucket long, n array<long>, k array<long>, i array<long>, s array<long>")
    return map_arrow(dealt.repartition("bucket").drop("bucket"), meet, "n long, k long, i long, s long")


def _rooted(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of `shared` with the component of their text, of shingles that lie in more than one component."""
    own = shared.withColumn("root", F.col("n")) if roots is None else shared.join(roots.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    several = own.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("s")
    return own.join(several, "s", "left_semi")


def _possible(similarity: float) -> Column:
    """Whether texts of kx and ky shingles can be so similar if their first common shingle is at ix and iy."""
    least = F.lit(similarity / (1 + similarity)) * (F.col("kx") + F.col("ky")) - 1e-6
    return F.least(F.col("kx") - F.col("ix"), F.col("ky") - F.col("iy")) >= least


def _star(rows: DataFrame, turn: int, similarity: float) -> DataFrame:
    """a, b: of every text, the one it shares most first shingles with among those that stand for a shingle this turn."""
    order = F.struct(F.xxhash64("n", F.lit(turn)).alias("h"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("k").alias("ky"), F.col("i").alias("iy"))
    heads = rows.groupBy("s").agg(F.min(order).alias("head")).select("s", "head.m", "head.other", "head.ky", "head.iy")
    met = rows.withColumnsRenamed({"k": "kx", "i": "ix"}).join(heads, "s").filter((F.col("root") != F.col("other")) & _possible(similarity))
    return met.groupBy("n", "m").agg(F.count("*").alias("c")).groupBy("n").agg(F.max(F.struct("c", "m")).alias("best")).select(F.col("n").alias("a"), F.col("best.m").alias("b"))


#: Bits of a text's sketch, and texts of a shingle that are compared with each other in one task.
SKETCH_BITS, BLOCK = 1024, 1000


def _sketch(kinds: np.ndarray) -> bytes:
    """Bits set where an odd number of shingles fall: sets that differ in d shingles have sketches that differ in d bits at most."""
    odd = np.bincount((kinds & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) % 2
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _near(x: np.ndarray, y: np.ndarray, roots: np.ndarray, k: np.ndarray, i: np.ndarray, sketches: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows x and y whose texts lie in different components and can be so similar by places, sizes and sketches."""
    share = similarity / (1 + similarity)
    total = k[x][:, None] + k[y][None, :]
    rest = np.minimum((k - i)[x][:, None], (k - i)[y][None, :])
    a, b = np.nonzero((roots[x][:, None] != roots[y][None, :]) & (rest >= share * total - 1e-6))
    a, b = x[a], y[b]
    kept = [np.empty(0, bool)]
    for j in range(0, len(a), 100_000):
        u, v = a[j : j + 100_000], b[j : j + 100_000]
        apart = np.bitwise_count(sketches[u] ^ sketches[v]).sum(axis=1, dtype=np.int64)
        kept.append(apart <= (1 - 2 * share) * (k[u] + k[v]) + 1e-6)
    kept = np.concatenate(kept)
    return a[kept], b[kept]


def _across(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of texts of different components that share a first shingle and can be so similar.

    The texts of a shingle meet in a task and only pairs that pass become rows. Where a shingle has many texts they are dealt into
    blocks, and every two blocks meet in a task of their own, so that what a task holds is bounded.
    """
    blocks = rows.groupBy("s").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("n"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.join(blocks, "s").withColumn("own", own).withColumn("other", other).join(nodes.select("n", "sketch"), "n")
    dealt = dealt.select("s", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "n", "root", "k", "i", "sketch")

    def meet(batches):
        held = None

        def pairs_of(group):
            """Pairs of whole groups of rows, in which s, low and high are sorted."""
            s, low, high, own, n, root, k, i = (group.column(c).to_numpy() for c in ("s", "low", "high", "own", "n", "root", "k", "i"))
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(s), -1)
            starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            found = []
            for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(s)]):
                here = np.arange(first, end)
                if low[first] != high[first]:
                    x, y = here[own[here] == low[first]], here[own[here] == high[first]]
                else:
                    x = y = here
                for j in range(0, len(x), BLOCK):
                    a, b = _near(x[j : j + BLOCK], y, root, k, i, sketches, similarity)
                    found.append(np.stack([n[a], n[b]]))
            both = np.sort(np.concatenate(found, axis=1), axis=0) if found else np.empty((2, 0), np.int64)
            return np.unique(both, axis=1)

        def out(group):
            both = pairs_of(group)
            for j in range(0, both.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[j : j + 100_000]) for c in both], names=["a", "b"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [held.column(c).to_numpy() for c in ("s", "low", "high")]
            cut = int(np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in keys]))[-1]) + 1 if any((c != c[-1]).any() for c in keys) else 0
            if cut:
                yield from out(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from out(held)

    sorted_ = dealt.repartition("s", "low", "high").sortWithinPartitions("s", "low", "high")
    return map_arrow(sorted_, meet, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, texts: int) -> DataFrame:
    """The similar pairs, in as many steps as keep the sets that one step shuffles near a third of the corpus."""
    steps, found = 1 + 3 * pairs.count() // max(1, texts), None
    for step in range(steps):
        part = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(steps)) == step)
        new = _released(_similar(part, sets, similarity), "similar")
        found = new if found is None else found.unionByName(new)
    return found


def _near_prints(nodes: DataFrame) -> DataFrame:
    """a, b: texts to compare by their fingerprints, links by segment popcounts between the first text of each, and this one with the others."""
    heads = store(nodes.groupBy("fp").agg(F.min("n").alias("m")), "heads")
    near = links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("m").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("m").alias("y")), "b")
    same = nodes.join(heads, "fp").filter("n <> m").select(F.col("m").alias("a"), F.col("n").alias("b"))
    out = _released(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(same).distinct(), "pairs")
    discard(heads)
    return out


def _linked(docs: DataFrame, nodes: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame | None:
    """node, root: components of all pairs of texts that are similar, exactly.

    Links of fingerprints come first; shared first shingles then give the similar pairs that these do not connect.
    """
    texts, roots = nodes.count(), None

    def compared(pairs: DataFrame) -> int:
        """Verify the pairs and renew the components by the similar ones."""
        nonlocal roots
        # Only sets that this turn compares: kept for all turns they would be most of the corpus once more.
        wanted = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct().join(nodes.select("n", "t"), "n").select("n", "t.t1", "t.t2")
        sets = _released(_sets(docs, wanted, text_col, words), "sets")
        new = _verified(pairs, sets, similarity, texts)
        discard(sets)
        discard(pairs)
        found = new.count()
        if found:
            # A text and its root stand for all links of the turns before.
            before, links_ = roots, new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = store(components(links_), "roots")
            if before is not None:
                discard(before)
        discard(new)
        return found

    compared(_near_prints(nodes))
    rows = _released(_shared(nodes), "shared")
    total, found = rows.count(), 0
    for turn in range(STARS + 1):
        before, rows = rows, _released(_rooted(rows.drop("root"), roots), "open")
        discard(before)
        own = rows.groupBy("s", "root").agg(F.count("*").cast("double").alias("c")).groupBy("s").agg((F.pow(F.sum("c"), F.lit(2)) - F.sum(F.col("c") * F.col("c"))).alias("p"))
        left = own.agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0] / 2
        if not left:
            break
        last = turn == STARS or turn and (left <= PAIRS_A_ROW * total or not found)
        found = compared(store(_across(rows, nodes, similarity) if last else _star(rows, turn, similarity), "pairs"))
        if last:
            break
    return roots


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row, that of the smallest id, of each group of exact or near copies.

    Near copies are texts linked by a Jaccard similarity of their shingle sets of `similarity` at least. Texts whose
    SimHash fingerprints link are compared first, which connects most copies. Every similar pair moreover
    shares one of the first shingles of both sets in any fixed order, so a join by these finds all; the order is that of
    frequency in a sample, which only saves work. Then each text is compared with one of those it meets, for a few
    rounds, as most copies are connected so; then all pairs that still lie between components. All are verified on
    the full sets. Null text counts as empty; empty texts are copies of each other.
    """
    frequent, counts = _frequent(docs, text_col, words)

    def run(batches):
        for batch in slices(batches, 500):
            out = []
            for t in batch.column(3):
                hashes = shingle_hashes(t.as_py(), words)
                kinds = np.unique(hashes)
                out.append((majority(hashes), xxhash.xxh3_128_hexdigest(kinds.astype("<u8").tobytes()), len(kinds), _prefix(kinds, frequent, counts, similarity).view(np.int64), _sketch(kinds)))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["id", "t1", "t2", "fp", "u", "k", "firsts", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), *_text_key(text_col), F.col(text_col).alias("text"))
    marked = store(map_arrow(own, run, f"id {kind}, t1 long, t2 long, fp long, u string, k long, firsts array<long>, sketch binary"), "marked")
    nodes = marked.groupBy("u").agg(F.min("k").alias("k"), F.min(F.struct("t1", "t2")).alias("t"), F.min("fp").alias("fp"), F.first("firsts").alias("firsts"), F.first("sketch").alias("sketch"))
    nodes = _released(nodes.withColumn("n", F.monotonically_increasing_id()), "nodes")
    made, marked = marked, store(marked.drop("firsts", "k", "fp", "sketch"), "marked")
    discard(made)
    roots = _linked(docs, nodes, text_col, words, similarity)
    named = nodes.select("u", F.col("n").alias("root"))
    if roots is not None:
        named = nodes.select("u", "n").join(roots.withColumnRenamed("node", "n"), "n", "left").select("u", F.coalesce("root", "n").alias("root"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    lows = marked.groupBy("u").agg(F.min(order).alias("low"))
    kept = lows.join(named, "u").groupBy("root").agg(F.min("low").alias("low"))
    columns = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    rows = docs.select(*_text_key(text_col), columns.alias("row"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("order"))
    rows = rows.groupBy("t1", "t2").agg(F.min_by("row", "order").alias("row"))
    rows = rows.join(kept.select("low.t1", "low.t2"), ["t1", "t2"], "left_semi")
    return rows.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_copies(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
