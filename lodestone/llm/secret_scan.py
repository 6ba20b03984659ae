"""Secrets by patterns and by two character Markov models.

Patterns mark assignments of secrets, access keys and long hexadecimal numbers. What they match, and the other tokens of
the same alphabet, are labelled samples: strings drawn at random on one side, ordinary identifiers on the other. A first
order Markov model of characters is trained on each, and every token that no pattern covers is compared by the
logarithm of the ratio of its two likelihoods. Tokens over the threshold are added to the spans of the patterns.

The samples are the distinct strings of the smallest hashes, so that copies count once and a string's place or the
number of tasks does not matter; their number is bounded by `sample`. Texts are read whole and scanned where they lie.

Defined cases: null is the empty text and has no spans; repeated rows each get their spans; without random strings
in the corpus that model is uniform over the alphabet, without identifiers no token is added; other columns may have
any name; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.common import free_name, map_arrow, numbered, read_table, slices, store

KINDS = ("assign", "access", "hex", "markov")
# The patterns of the base kinds and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A token has a letter: numbers, dates and telephone numbers are as random as secrets, but none.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{8,}")
CODES = np.full(128, -1, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Row of the transition tables for the start of a string.
START = len(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in code points, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A maximal run is one match, so looking for long runs only drops the matches that are too short.
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def uncovered(text: str, spans: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """Tokens of at least that length, eight or more, that no span touches."""
    out, i, reach = [], 0, -1
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if b - a < least:
            continue
        while i < len(spans) and spans[i][0] < b:
            reach = max(reach, spans[i][2])
            i += 1
        if reach <= a:
            out.append((a, b))
    return out


def secret_values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The random part of every span: the value of an assignment, else all of it."""
    return [ASSIGN.match(text, a)[2] if kind == 0 else text[a:b] for a, kind, b in spans]


def pairs_of(s: str) -> tuple[np.ndarray, np.ndarray]:
    """The different character pairs of a string as (before, after); its start is a character of its own."""
    codes = CODES[np.minimum(np.frombuffer(s.encode("utf-32-le"), np.uint32), 127)]
    before = np.concatenate([[START], codes[:-1]])
    good = (before >= 0) & (codes >= 0)
    return np.divmod(np.unique(before[good] * len(ALPHABET) + codes[good]), len(ALPHABET))


def transitions(strings: list[str]) -> np.ndarray:
    """How many strings have a character pair."""
    counts = np.zeros((len(ALPHABET) + 1, len(ALPHABET)))
    for s in strings:
        counts[pairs_of(s)] += 1
    return counts


@dataclass
class Model:
    """`ratio[a, b]`: log likelihood ratio of character b after a, random strings over identifiers."""

    ratio: np.ndarray

    def score(self, token: str) -> float:
        """Over the different pairs of a token, so that a repeated character is no evidence."""
        return float(self.ratio[pairs_of(token)].sum())


#: Observations at uniform that smooth a row of transitions.
WEIGHT = 20.0


def chain(seen: np.ndarray) -> np.ndarray:
    """Transition probabilities of counts."""
    return (seen + WEIGHT / len(ALPHABET)) / (seen.sum(1, keepdims=True) + WEIGHT)


def fit(random: list[str], ordinary: list[str]) -> Model | None:
    """Both models. That of random strings is half uniform, as a sample of one alphabet must not rule out others.

    Secrets that no pattern covers lie among the identifiers. Each of these is compared with the chain of all others,
    and only those that this chain explains better stay.
    """
    learned, known, plain = (chain(transitions(random)) + 1 / len(ALPHABET)) / 2, transitions(ordinary), []
    rows = known.sum(1)
    for s in ordinary:
        a, b = pairs_of(s)
        others = (known[a, b] - 1 + WEIGHT / len(ALPHABET)) / (rows[a] - np.bincount(a, minlength=len(rows))[a] + WEIGHT)
        if np.log(learned[a, b] / others).sum() < 0:
            plain.append(s)
    return Model(np.log(learned) - np.log(chain(transitions(plain)))) if plain else None


def train(docs: DataFrame, text_col: str = "text", sample: int = 4096) -> Model | None:
    """Models of the corpus from at most `sample` distinct strings of each label, those of the smallest hashes."""

    def run(batches):
        seen: list[set] = [set(), set()]
        heaps: list[list] = [[], []]
        for batch in slices(batches, 500):
            for v in batch.column(0):
                text = v.as_py() or ""
                spans = base_spans(text)
                found = (secret_values(text, spans), [text[a:b] for a, b in uncovered(text, spans, 8)])
                for label, strings in enumerate(found):
                    for s in set(strings) - seen[label]:
                        h = xxhash.xxh64_intdigest(s.encode()) >> 1
                        if len(heaps[label]) < sample:
                            heapq.heappush(heaps[label], (-h, s))
                        elif h < -heaps[label][0][0]:
                            seen[label].discard(heapq.heapreplace(heaps[label], (-h, s))[1])
                        else:
                            continue
                        seen[label].add(s)
        rows = [(label, -h, s) for label in (0, 1) for h, s in heaps[label]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.int64(), pa.string()))], names=["label", "h", "s"])

    found = store(map_arrow(docs.select(text_col), run, "label int, h long, s string").distinct(), "strings")
    chosen = [[r["s"] for r in found.filter(F.col("label") == label).orderBy("h", "s").limit(sample).collect()] for label in (0, 1)]
    return fit(*chosen)


def scan(docs: DataFrame, model: Model | None, text_col: str = "text", least: int = 16, threshold: float = 12.0, name: str = "_secrets") -> DataFrame:
    """`docs` with an array of spans (kind, start, end, score) as last column; only spans of the models have a score.

    `threshold` is the least log likelihood ratio of a token, `least` its least length.
    """
    place = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in slices(batches, 500):
            out = []
            for v in batch.column(place):
                text = v.as_py() or ""
                spans = base_spans(text)
                more = [(a, 3, b, model.score(text[a:b])) for a, b in uncovered(text, spans, least)] if model else []
                all_ = sorted([(*s, None) for s in spans] + [s for s in more if s[3] >= threshold])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in all_])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*(f"c{i}" for i in range(batch.num_columns)), "spans"])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)), "spans array<struct<kind:string,start:long,end:long,score:double>>"])
    return map_arrow(numbered(docs), run, schema).toDF(*docs.columns, name)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    name = free_name(docs, "_secrets")
    found = scan(docs, train(docs), name=name)
    count = lambda kind: F.size(F.filter(name, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(name, lambda s: s["kind"] != KINDS[3])
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col(name)).alias("spans")
    )


QUERIES = {"op12_secrets": op12_secrets}
ORACLES: dict[str, str] = {}
