"""Sequence packing by non-negative least squares over a length histogram.

Documents become token ids with an end id, cut into full windows and a remainder. Remainders are counted by length;
the histogram has at most `window` entries, whatever the corpus. Shallow combinations of lengths that fill a window
exactly are enumerated, and non-negative least squares finds how often to use each so that their use matches the
histogram. Counts are rounded to what the histogram can give; the residual pieces are packed greedily, longest first,
into one run of tokens cut at window borders, and the last part window is cut at powers of two, which need no padding.

Only the histogram and the plan reach the driver. Every remainder has a number within its length (a base per task and
length from a windowed sum, plus its place in the task), and the plan maps ranges of numbers to sequences and offsets,
so that pieces are placed without gathering any length in one place. Token ids are written once and read once.

Defined cases: null text is empty and has only the end id; repeated rows are documents of their own; an empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

import functools
import itertools
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.llm.common import WordCodes, code_array, map_arrow, ranges, read_table, slices, store

CACHED_WORDS = 250_000
JOINED_WORDS = 200


class Encoder:
    """Token ids of texts by a `tokenizers` file. White space separates tokens, so that each different word is encoded once.
    What is known is kept for the next texts."""

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.clear()

    def clear(self) -> None:
        self.codes, self.starts, self.ids = WordCodes(), np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and the number of ids of each; words are joined by spaces, ids told apart by their place."""
        joined = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        found = self.tokenizer.encode_batch([" ".join(w) for w in joined], add_special_tokens=False)
        counts = []
        for some, e in zip(joined, found):
            sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
            places = np.fromiter((o[0] for o in e.offsets), np.int64)
            counts.append(np.bincount(np.searchsorted(np.cumsum(sizes) - sizes, places, side="right") - 1, minlength=len(some)))
        return np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32), np.concatenate(counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        if len(self.codes) > CACHED_WORDS:
            self.clear()
        known, counts, parts = len(self.codes), [], []
        for text in texts:
            if text.isascii() and "<|" not in text:  # lower-casing is the tokenizer's own first step; markers are matched before it
                text = text.lower()
            words = text.replace("\n", " ").split(" ")
            parts.append(code_array(self.codes, words))
            counts.append(len(words))
        fresh = list(itertools.islice(self.codes, known, None))
        if fresh:
            ids, sizes = self._encode_words(fresh)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        codes = np.concatenate(parts) if parts else np.empty(0, np.int64)
        sizes = self.starts[codes + 1] - self.starts[codes]
        ids = self.ids[np.repeat(self.starts[codes], sizes) + ranges(sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return ids, np.diff(ends)


@functools.lru_cache(maxsize=1)
def encoder_of(json: str) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    return Encoder(json)


def tokenised(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Stored rows: id, task, ids (little-endian 16- or 32-bit), n, rest (n mod window), full_before, rest_before: how many
    full windows and remainders of this length came before in the task."""
    json = Path(tokenizer).read_text(encoding="utf-8")

    def run(batches):
        encoder = encoder_of(json)
        task, full, rests = TaskContext.get().partitionId(), 0, np.zeros(window, np.int64)
        for batch in slices(batches, 500):
            ids, counts = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum(counts)
            rows = []
            for a, b in zip((ends - counts).tolist(), ends.tolist()):
                n = b - a + 1
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4" if encoder.wide else "<u2")
                rows.append((task, own.tobytes(), n, n % window, full, int(rests[n % window])))
                full += n // window
                rests[n % window] += 1
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "task", "ids", "n", "rest", "full_before", "rest_before"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, task int, ids binary, n long, rest int, full_before long, rest_before long"
    return store(map_arrow(own, run, schema), "tokens")


def combinations(histogram: np.ndarray, depth: int, most: int) -> list[tuple[int, ...]]:
    """Up to `most` combinations of at most `depth` present lengths that sum to the window, frequent lengths first."""
    window = len(histogram) - 1
    present = [int(x) for x in np.argsort(-histogram, kind="stable") if x and histogram[x]]
    here, found = set(present), {}
    for parts in range(1, depth + 1):
        breadth = len(present) if parts <= 2 else max(1, int((2 * most) ** (1 / (parts - 1))))
        for head in itertools.combinations_with_replacement(present[:breadth], parts - 1):
            last = window - sum(head)
            if last in here:
                found.setdefault(tuple(sorted((*head, last), reverse=True)))
            if len(found) >= most:
                return list(found)
    return list(found)


def least_squares(histogram: np.ndarray, patterns: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths is nearest to the histogram: cyclic coordinate descent."""
    left = histogram.astype(float).tolist()
    uses = [[(x, p.count(x)) for x in dict.fromkeys(p)] for p in patterns]
    norms = [sum(k * k for _, k in u) for u in uses]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, u in enumerate(uses):
            step = max(-x[i], sum(k * left[length] for length, k in u) / norms[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for length, k in u:
                    left[length] -= k * step
        if moved < 0.25:
            break
    return np.array(x)


class Plan:
    """Ranges of numbered pieces by length, and where they go. Held in arrays of bounded size."""

    def __init__(self, histogram: np.ndarray, depth: int = 4, most: int = 4096):
        window = self.window = len(histogram) - 1
        left, rows, sequence = histogram.copy(), [], 0
        used = np.zeros(window + 1, np.int64)
        patterns = combinations(histogram, depth, most)
        counts = least_squares(histogram, patterns)
        for i in np.argsort(-counts, kind="stable"):
            p = patterns[i]
            repeats = min([int(counts[i] + 0.5), *(int(left[x]) // p.count(x) for x in p)])
            if p == (window,):
                repeats = int(left[window])
            if not repeats:
                continue
            offset = 0
            for x in p:
                rows.append((x, used[x], sequence, offset))
                used[x] += repeats
                left[x] -= repeats
                offset += x
            sequence += repeats
        position = 0
        for x in range(window, 0, -1):
            if left[x]:
                rows.append((x, used[x], -1, position))
                position += x * int(left[x])
        self.residual, self.total = sequence, position
        whole = position // window * window
        cuts, rest = [], position - whole
        for bit in range(window.bit_length(), -1, -1):
            if rest >> bit & 1:
                cuts.append(whole + sum(1 << b for b in range(bit + 1, window.bit_length() + 1) if rest >> b & 1))
        self.tail = np.array(cuts, np.int64)  # where the sequences after the last whole window begin
        rows.sort()
        self.length, self.low, self.sequence, self.offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 4))
        self.key = self.length * (1 << 48) + self.low

    def place(self, length: int, number: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence, offset) of the parts of one piece, in order."""
        i = int(np.searchsorted(self.key, length * (1 << 48) + number, side="right")) - 1
        past = number - int(self.low[i])
        if self.sequence[i] >= 0:
            return [(length, int(self.sequence[i]) + past, int(self.offset[i]))]
        parts, at, end, whole = [], int(self.offset[i]) + past * length, 0, self.total // self.window
        stop = at + length
        while at < stop:
            if at < whole * self.window:
                k, begin = at // self.window, at // self.window * self.window
                end = begin + self.window
            else:
                t = int(np.searchsorted(self.tail, at, side="right")) - 1
                k, begin = whole + t, int(self.tail[t])
                end = int(self.tail[t + 1]) if t + 1 < len(self.tail) else self.total
            size = min(end, stop) - at
            parts.append((size, self.residual + k, at - begin))
            at += size
        return parts


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, most: int = 4096) -> DataFrame:
    """Pieces: id, start (ids of the document before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    tokens = tokenised(docs, tokenizer, window, end_id, id_col, text_col)
    rests = tokens.groupBy("task", "rest").agg(F.count("*").alias("k"))
    fulls = tokens.groupBy("task").agg(F.sum(F.expr(f"n div {window}")).alias("k")).select("task", F.lit(window).alias("rest"), "k")
    counts = store(rests.unionByName(fulls), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.filter("rest > 0").groupBy("rest").agg(F.sum("k").alias("k")).collect():  # at most `window` rows
        histogram[row["rest"]] = row["k"]
    plan = Plan(histogram, depth, most)
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0)))
    both = bases.filter(F.col("rest") < window).join(bases.filter(F.col("rest") == window).select("task", F.col("base").alias("full_base")), "task")
    numbered = tokens.join(both.select("task", "rest", "base", "full_base"), ["task", "rest"])
    numbered = numbered.select("id", "ids", "n", "rest", (F.col("full_base") + F.col("full_before")).alias("first_full"), (F.col("base") + F.col("rest_before")).alias("number"))

    def run(batches):
        for batch in slices(batches, 500):
            out = []
            for r, (ids, n, rest, first, number) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                own = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                at = 0
                pieces = [(window, first + j) for j in range(n // window)] + [(rest, number)] * (rest > 0)
                for length, num in pieces:
                    for size, sequence, offset in plan.place(length, num):
                        out.append((r, at, size, own[at : at + size].tobytes(), n, sequence, offset))
                        at += size
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return map_arrow(numbered, run, schema).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(read_table(spark, sf_dir, "documents"), default_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
