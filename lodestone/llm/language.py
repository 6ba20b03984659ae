"""Language identification by words, with Viterbi labels for spans of mixed-language text.

Training counts character n-grams of the words of labelled documents. A word's scores are the log-likelihoods of its
n-grams under each language; the ranges of its letters (script) first narrow the languages to those seen in that
script. Over a text, Viterbi picks the label of every word, paying a penalty for each switch, so that a stray word
keeps the language around it while a real passage in another language becomes a span of its own. The text's language
is the one whose spans hold most letters, and the score is its share.

The model is fitted on the driver on at most `sample` documents for each language, taken by the order of a hash of
their id, and has a bounded size; labelling is one pass without a shuffle. All texts of a batch take a Viterbi step
together, so a very long text costs its own length only.

Defined cases: null text or text without a letter is `und` with score 0 and no spans; without labelled documents
every text is `und`; repeated rows each get a row; languages that tie in letters are taken in name order; only the
named columns are read.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestone.llm.common import WordCodes, code_array, crc_remainder, map_arrow, read_table, slices

#: First code points of script ranges (Unicode blocks) and their scripts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "other"),
    (0x20000, "Han"), (0x30000, "other"),
]
_FROM = [a for a, _ in SCRIPTS]
CACHED_WORDS = 400_000
NEVER = -1e6


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
GRAMS = (1, 2, 3, 4)


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def scripts_of(words: list[str]) -> np.ndarray:
    """Number in SCRIPTS of the range that holds each word's first letter. No word is empty."""
    return np.searchsorted(_FROM, [ord(w[0]) for w in words], side="right") - 1


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word as a whole and of its 1- to 4-grams, ends marked; and the number of the word that each is of."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts, word = ends - sizes, np.repeat(np.arange(len(words)), sizes)
    powers, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(code), b, np.uint64)])) for b in (BASE, BASE_INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers[:-1], dtype=np.uint64)])
    keys, owners = [_mixed((sums[ends] - sums[starts]) * inverse[starts], 0)], [np.arange(len(words))]
    for n in GRAMS:
        whole = np.zeros(max(0, len(code) - n + 1), np.uint64)
        for j in range(n):
            whole = whole * BASE + code[j : len(code) - n + 1 + j]
        inside = (word[: len(whole)] == word[n - 1 :]) & (sizes[word[: len(whole)]] > n)
        keys.append(_mixed(whole[inside], n))
        owners.append(word[: len(whole)][inside])
    return np.concatenate(keys), np.concatenate(owners)


class Model:
    """Log-likelihoods of the `most` frequent n-grams under each language, and the languages seen in each script range."""

    def __init__(self, texts: dict[str, list[str]], most: int = 60_000, floor: float = 0.5, share: float = 0.01):
        self.langs = sorted(texts)
        found, seen = [], np.zeros((len(SCRIPTS), len(self.langs)))
        for i, lang in enumerate(self.langs):
            counts: Counter = Counter()
            for word, k in Counter(w for t in texts[lang] for w in t.lower().split()).items():
                if plain := letters_of(word):
                    counts[plain] += k
            words, weight = list(counts), np.array(list(counts.values()), float)
            if words:
                np.add.at(seen[:, i], scripts_of(words), weight)
                keys, owner = gram_keys(words)
                kinds, where = np.unique(keys, return_inverse=True)
                found.append((i, kinds, np.bincount(where, weights=weight[owner])))
        every = np.unique(np.concatenate([np.empty(0, np.uint64), *(k for _, k, _ in found)]))
        table = np.full((len(every), len(self.langs)), floor)
        for i, kinds, counts in found:
            table[np.searchsorted(every, kinds), i] += counts
        kept = np.sort(np.argsort(-table.sum(axis=1), kind="stable")[:most])
        self.keys, table = every[kept], table[kept]
        logs = np.log(table / np.maximum(table.sum(axis=0, keepdims=True), 1e-300))
        self.table = logs - logs.max(axis=1, keepdims=True) if len(self.langs) else logs
        names = np.array([name for _, name in SCRIPTS])
        seen = np.stack([seen[names == name].sum(axis=0) for name in names])
        self.scripts = seen >= share * np.maximum(1, sum(seen[np.argmax(names == name)] for name in set(names)))

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of words relative to their best language, and their numbers of letters."""
        plain = list(map(letters_of, words))
        letters = np.fromiter(map(len, plain), np.int32, len(plain))
        out = np.zeros((len(words), len(self.langs)), np.float32)
        some = np.flatnonzero(letters)
        if not len(some) or not len(self.keys):
            return out, letters
        plain = [plain[i] for i in some.tolist()]
        keys, owner = gram_keys(plain)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        at, owner = at[known], owner[known]
        sums = np.stack([np.bincount(owner, weights=self.table[at, i], minlength=len(plain)) for i in range(len(self.langs))], axis=1)
        sums /= np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(plain))))[:, None]
        allowed = self.scripts[scripts_of(plain)]
        sums[~allowed & allowed.any(axis=1, keepdims=True)] = NEVER
        out[some] = sums - sums.max(axis=1, keepdims=True)
        return out, letters


class Tagger:
    """Labels of words, with scores of words kept for the next texts."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.clear()

    def clear(self) -> None:
        self.codes, self.table, self.letters = WordCodes(), np.empty((0, len(self.model.langs)), np.float32), np.empty(0, np.int32)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > CACHED_WORDS:
            self.clear()
        known, parts = len(self.codes), []
        for text in texts:
            parts.append(code_array(self.codes, text.lower().split()))
        if len(self.codes) > known:
            table, letters = self.model.scores(list(itertools.islice(self.codes, known, None)))
            self.table, self.letters = np.concatenate([self.table, table]), np.concatenate([self.letters, letters])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number of every word, letters of every word, words of every text."""
        codes, sizes = self.words(texts)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begin, long = starts[order], sizes[order]
        active = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")  # texts with a word at each step
        count = len(self.model.langs)
        back = np.empty((len(codes), count), np.uint8)
        labels = np.zeros(len(codes), np.uint8)
        value = np.zeros((len(texts), count), np.float32)
        for t, k in enumerate(active.tolist()):
            at = begin[:k] + t
            best = value[:k].argmax(axis=1)
            jump = value[np.arange(k), best] - self.penalty
            stay = value[:k] >= jump[:, None]
            back[at] = np.where(stay, np.arange(count, dtype=np.uint8), best[:, None].astype(np.uint8))
            value[:k] = np.maximum(value[:k], jump[:, None]) + self.table[codes[at]]
        last = value.argmax(axis=1).astype(np.uint8)
        for t in range(len(active) - 1, -1, -1):
            at = begin[: active[t]] + t
            labels[at] = last[: active[t]]
            last[: active[t]] = back[at, last[: active[t]]]
        return labels, self.letters[codes], sizes


def fit(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str, sample: int) -> Model:
    """At most `sample` documents of each language come to the driver."""
    own = docs.filter(allowed & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("at"))
    first = Window.partitionBy("lang").orderBy("at")
    rows = own.select("lang", "text", "at").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample).collect()
    texts: dict[str, list[str]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        texts[r["lang"]].append(r["text"])
    return Model(texts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 4.0) -> DataFrame:
    """id, lang, score, spans (lang, start, words) of every row; spans count whitespace-separated words from 0."""

    def run(batches):
        tagger = Tagger(model, penalty) if model.langs else None
        langs = np.array(model.langs, object)
        for batch in slices(batches, 1500):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names, scores, spans = [], [], []
            if tagger is None:
                names, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            else:
                labels, letters, sizes = tagger.label(texts)
                at = 0
                for n in sizes.tolist():
                    own, weight = labels[at : at + n], letters[at : at + n]
                    at += n
                    held = np.bincount(own, weights=weight, minlength=len(langs)) if n else np.zeros(len(langs))
                    if not held.sum():
                        names.append("und"), scores.append(0.0), spans.append([])
                        continue
                    names.append(langs[held.argmax()])
                    scores.append(float(held.max() / held.sum()))
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                    spans.append([{"lang": langs[own[c]], "start": c, "words": w} for c, w in zip(cuts.tolist(), np.diff(np.append(cuts, n)).tolist())])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["id", "lang", "score", "spans"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, lang string, score double, spans array<struct<lang string, start long, words long>>"
    return map_arrow(own, run, schema).withColumnRenamed("id", id_col)


#: Training documents for each language at most.
SAMPLE = 300


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, crc_remainder("doc_id", 4) != 2, "doc_id", "text", "lang", SAMPLE)
    out = identify(docs, model)
    return out.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans"))


QUERIES = {"op6_language": op6_language}
ORACLES: dict[str, str] = {}
