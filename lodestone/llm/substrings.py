"""Substring dedup: word windows that occur more than once, found by suffix automata of reference shards.

A word is removed if it lies in a window of `window` words whose sequence also starts anywhere else, in the same
document or another. Every window is assigned its seed, the least hash of the short word sequences inside it, so that
equal windows have equal seeds. A run is a maximal stretch of windows with one seed at one place. Seeds seen once need
no further look. The runs of a shared seed are the reference shard of that seed: its different contents, each with the
number of its occurrences, build a suffix automaton with occurrence counts, and the same contents are streamed through
it; wherever the matching statistic reaches the window length, the state tells how often the window occurs. Streaming
every document through every shard would cost documents times shards; by seeds a run meets only the shard that can match it.

A seed with one content has an automaton of one path, on which every window occurs as often as the content, so no
automaton is built. A seed with more than `shard_contents` contents is not gathered in a task: its windows, which all
hold the seed at a known offset, are counted by hash, combined in each task before they are shuffled.

Texts are keyed by a hash of 64 bits and their length, so copies share one result. Runs carry hashes only; words are
read again for the runs that need an automaton. What is stored is a few numbers for each of the runs, about one for
fifteen words, and the texts that hold a shared seed.

Defined cases: null text has no words; a text shorter than a window keeps all; repeated rows are documents of their own
(their windows occur elsewhere, so they are removed from both); an empty table gives no rows; only the named columns
are read, and other columns, whatever their names, pass through `clean` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.common import map_arrow, numbered, ranges, read_table, slices, store

SEED_WORDS = 6
CACHED_WORDS = 250_000
HELD_WINDOWS = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
RUN_BITS = 6  # a run has at most window - SEED_WORDS + 1 windows


class Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 3)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def find_runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, place of the seed, first window and number of windows of each run."""
    n, width = len(hashes), window - SEED_WORDS + 1
    if n < window:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    seeds = np.zeros(n - SEED_WORDS + 1, np.uint64)
    for i in range(SEED_WORDS):
        seeds = seeds * BASE + hashes[i : n - SEED_WORDS + 1 + i]
    seeds = _mixed(seeds)
    value, place, span = seeds, np.arange(len(seeds)), 1
    while span < width:
        step = min(span, width - span)
        left, right = value[: len(value) - step], value[step:]
        first = left <= right
        place = np.where(first, place[: len(place) - step], place[step:])
        value = np.where(first, left, right)
        span += step
    cut = np.flatnonzero(np.diff(place)) + 1
    start = np.concatenate([[0], cut])
    return value[start], place[start], start, np.diff(np.append(start, len(place)))


def content_hashes(hashes: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Polynomial hash of stretches of words, the same for the same words wherever they stand."""
    up, down = _powers(BASE, len(hashes)), _powers(BASE_INVERSE, len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return _mixed((sums[start + words] - sums[start]) * down[start] + words.astype(np.uint64))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t"), F.pmod(F.octet_length(text), F.lit(1 << 20)).cast("int").alias("size")]


def all_runs(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """h (seed), c (content), t and size (text), run (first window << RUN_BITS | windows) of every run of every row."""

    def run(batches):
        known = Hashes()
        for batch in slices(batches, 500):
            parts = []
            for text, t, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.encode().split()
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                seed, place, start, count = find_runs(hashes, window)
                if not len(seed):
                    continue
                content = content_hashes(hashes, start, count + window - 1) + (place - start).astype(np.uint64) * BASE
                parts.append((seed.view(np.int64), content.view(np.int64), np.full(len(seed), t, np.int64), np.full(len(seed), size, np.int32), start << RUN_BITS | count))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32), np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "c", "t", "size", "run"])

    own = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), *text_key(F.col(text_col)))
    return map_arrow(own, run, "h long, c long, t long, size int, run long")


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with weights that add up to occurrence counts of every substring."""

    def __init__(self):
        self.next, self.link, self.length, self.weight = [{}], [-1], [0], [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.weight.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state for exactly the strings of `p` followed by `word`."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list, weight: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            self.weight[last] += weight

    def close(self) -> None:
        """Carry weights to suffixes, longest first."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.weight[self.link[v]] += self.weight[v]

    def window_counts(self, words: list, window: int):
        """For each window of `words`, in order, how often it occurs: the state where the matching statistic is cut to `window`."""
        state, matched = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            yield self.weight[state] if matched >= window else 0


def repeated_in_shard(contents: list[tuple[int, int, list]], window: int) -> list[tuple[int, int]]:
    """(content, bits) with bit j set where window j of the content occurs at least twice over all contents."""
    automaton = SuffixAutomaton()
    for _, weight, words in contents:
        automaton.add(words, weight)
    automaton.close()
    out = []
    for c, _, words in contents:
        bits = 0
        for j, count in enumerate(automaton.window_counts(words, window)):
            if count >= 2:
                bits |= 1 << (j - window + 1)
        out.append((c, bits))
    return out


def _shard_flags(words: DataFrame, window: int) -> DataFrame:
    """h, c, bits. `words` has h, c, m, words (the content, separated by spaces); the rows of a seed come together."""

    def run(batches):
        here, held = None, []
        for batch in slices(batches, 5000):
            out = []
            for h, c, m, text in zip(*(x.to_pylist() for x in batch.columns)):
                if h != here:
                    out += [(here, c_, b) for c_, b in repeated_in_shard(held, window)]
                    here, held = h, []
                held.append((c, m, text.split(" ")))
            yield _flag_batch(out)
        yield _flag_batch([(here, c_, b) for c_, b in repeated_in_shard(held, window)])

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(words.repartition(n, "h").sortWithinPartitions("h"), run, "h long, c long, bits long")


def _flag_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "c", "bits"])


def _combined(parts: list) -> pa.RecordBatch:
    """One row for each different window of what a task holds: its seed, hash, number of occurrences and places."""
    h, c, t, size, start, copies = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
    places = pa.StructArray.from_arrays([pa.array(x[order]) for x in (t, size, start)], names=["t", "size", "start"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), places)
    return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(c[first]), pa.array(np.add.reduceat(copies[order], first)), lists], names=["h", "c", "n", "places"])


def repeats(docs: DataFrame, text_col: str = "text", window: int = 35, shard_contents: int = 1000) -> DataFrame:
    """t, size, kept, n_removed, spans (first, words): one row for each different text that loses words."""
    runs = store(all_runs(docs, text_col, window), "runs")
    seeds = runs.groupBy("h").agg(F.count("*").alias("seen"), (F.min("c") == F.max("c")).alias("single")).filter("seen > 1").select("h", "single")
    seeds = store(seeds, "seeds")  # as a side of its own, so that the join can split a hot seed
    shared = store(runs.join(seeds, "h"), "shared")
    mixed = shared.filter("NOT single")
    contents = store(mixed.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("t", "size", "run")).alias("at")), "contents")
    hot = store(contents.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > shard_contents).select("h"), "hot")
    cold = contents.join(hot, "h", "left_anti")
    examples = cold.select("at.t", "at.size", F.struct("h", "c", "m", "at.run").alias("one")).groupBy("t", "size").agg(F.collect_list("one").alias("examples"))
    crowded = mixed.join(hot, "h", "left_semi").select("t", "size", F.struct("h", "run").alias("one")).groupBy("t", "size").agg(F.collect_set("one").alias("crowded"))
    involved = shared.select("t", "size").distinct().join(examples, ["t", "size"], "left").join(crowded, ["t", "size"], "left")
    held = docs.filter(F.col(text_col).isNotNull()).select(*text_key(F.col(text_col)), F.col(text_col).alias("text"))
    held = held.groupBy("t", "size").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = store(held.join(involved, ["t", "size"]), "texts")

    def content_words(batches):
        for batch in slices(batches, 500):
            out = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().split()
                for one in found:
                    start, count = one["run"] >> RUN_BITS, one["run"] & ((1 << RUN_BITS) - 1)
                    out.append((one["h"], one["c"], one["m"], b" ".join(words[start : start + count + window - 1]).decode()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["h", "c", "m", "words"])

    with_words = map_arrow(texts.filter("examples IS NOT NULL").select("text", "examples"), content_words, "h long, c long, m long, words string")
    flags = store(_shard_flags(with_words, window), "flags")

    def single_windows(batches):
        known, parts, held = Hashes(), [], 0
        for batch in slices(batches, 500):
            for t, size, text, copies, found in zip(*(x.to_pylist() for x in batch.columns)):
                words = text.encode().split()
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                run = np.array([one["run"] for one in found], np.int64)
                count = run & ((1 << RUN_BITS) - 1)
                start = np.repeat(run >> RUN_BITS, count) + ranges(count)
                h = np.repeat(np.array([one["h"] for one in found], np.int64), count)
                c = content_hashes(hashes, start, np.full(len(start), window, np.int64)).view(np.int64)
                parts.append((h, c, np.full(len(h), t, np.int64), np.full(len(h), size, np.int32), start, np.full(len(h), copies, np.int64)))
                held += len(h)
            if held > HELD_WINDOWS:
                yield _combined(parts)
                parts, held = [], 0
        if held:
            yield _combined(parts)

    windows = texts.filter("crowded IS NOT NULL").select("t", "size", "text", "copies", "crowded")
    windows = store(map_arrow(windows, single_windows, "h long, c long, n long, places array<struct<t long, size int, start long>>"), "windows")
    often = windows.groupBy("h", "c").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "c")

    all_bits = F.expr(f"shiftleft(1L, cast(run & {(1 << RUN_BITS) - 1} as int)) - 1")
    first = F.expr(f"shiftright(run, {RUN_BITS})").alias("start")
    found = [
        shared.filter("single").select("t", "size", first, all_bits.alias("bits")),
        mixed.join(flags.filter("bits <> 0"), ["h", "c"]).select("t", "size", first, "bits"),
        windows.join(often, ["h", "c"]).select(F.inline("places")).select("t", "size", "start", F.lit(1).cast("long").alias("bits")),
    ]
    spots = found[0].unionByName(found[1]).unionByName(found[2]).distinct()
    spots = spots.groupBy("t", "size").agg(F.collect_list(F.struct("start", "bits")).alias("spots"))

    def cut(batches):
        for batch in slices(batches, 500):
            out = []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                start, bits = (np.array([f[k] for f in found], np.int64) for k in ("start", "bits"))
                for j in range(int(bits.max()).bit_length()):
                    own = start[bits >> j & 1 == 1] + j
                    np.add.at(edge, own, 1)
                    np.add.at(edge, own + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                steps = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join(words[i] for i in np.flatnonzero(~gone).tolist()).decode()
                out.append((kept, int(gone.sum()), [{"first": a, "words": b - a} for a, b in zip(steps[::2].tolist(), steps[1::2].tolist())]))
            columns = list(zip(*out)) or [()] * 3
            kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), kind)))], names=["t", "size", "kept", "n_removed", "spans"])

    met = texts.select("t", "size", "text").join(spots, ["t", "size"])
    return map_arrow(met, cut, "t long, size int, kept string, n_removed long, spans array<struct<first long, words long>>")


SPACES = r"[\x20\x09-\x0D]+"


def clean(docs: DataFrame, text_col: str = "text", window: int = 35, shard_contents: int = 1000, name: str = "_spans") -> DataFrame:
    """`docs` with `text_col` freed of repeated windows where it has any, and the removed spans as last column `name`."""
    lost = store(repeats(docs, text_col, window, shard_contents), "repeats").select(F.col("t").alias("_t"), F.col("size").alias("_size"), F.col("kept").alias("_kept"), F.col("spans").alias("_spans"))
    text = F.col(f"c{docs.columns.index(text_col)}")
    t, size = text_key(text)
    met = numbered(docs).withColumns({"_t": t, "_size": size}).join(lost, ["_t", "_size"], "left")
    columns = [(F.coalesce("_kept", text) if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return met.select(*columns, F.coalesce("_spans", F.array().cast(lost.schema["_spans"].dataType)).alias(name))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = store(repeats(docs), "repeats").select("t", "size", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    plain = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), ""), " ")
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), "")).cast("long")
    own = docs.select("doc_id", n_words.alias("n_words"), F.sha2(plain, 256).alias("whole_sha256"), *text_key(F.col("text")))
    met = own.join(lost, ["t", "size"], "left")
    return met.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


QUERIES = {"op4_substrings": op4_substrings}
ORACLES: dict[str, str] = {}
