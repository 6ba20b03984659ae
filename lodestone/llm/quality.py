"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)); by the sum-of-squares
identity all pairwise interactions cost as much as the features are many. Words enter as L2-normalised counts per hash
bucket, statistics and metadata as indicators of their quantile bin.

The machine is fitted on the driver on at most `sample` labelled rows, taken by the order of a hash of their id; scoring
is one pass over all documents without a shuffle. The model has a fixed size of a few megabytes.

Defined cases: null text is scored as an empty text, which has statistics but no words; null metadata counts as 0;
labels that are null are no labels, a document with several has the least; without labelled rows of both kinds every
score is 0.5; repeated rows each get a score; other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.common import crc_remainder, map_arrow, numbered, read_table, slices

BUCKETS, RANK, BINS = 1 << 14, 6, 10
CACHED_WORDS = 150_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
UPPER, LOWER, DIGIT = (np.array([lo <= i <= hi for i in range(256)]) for lo, hi in ((65, 90), (97, 122), (48, 57)))
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "!?.,;:'\"()-"]] = True


class Buckets(dict):
    """Word -> hash bucket."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7) % BUCKETS
        return value


def features(text: str | None, meta: list[float], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets and L2-normalised counts of the words; statistics and metadata as numbers."""
    raw = (text or "").encode()
    size = max(1, len(raw))
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.lower().split()
    n = max(1, len(words))
    codes = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    found, counts = np.unique(codes, return_counts=True)
    lines = raw.split(b"\n")
    letters = max(1, int(of[UPPER].sum() + of[LOWER].sum()))
    statistics = [
        np.log1p(len(raw)), len(raw) / n, int(of[UPPER].sum()) / letters, int(of[DIGIT].sum()) / size, int(of[SYMBOLS].sum()) / size, int(of[MARKS].sum()) / size,
        int(of[33]) / size, int(of[128:].sum()) / size, int((codes[1:] == codes[:-1]).sum()) / n, len(found) / n, int(counts.max(initial=0)) / n,
        int(of[46] + of[63]) / n, len(set(lines)) / len(lines), len(lines) / n, (int(of[UPPER].sum()) + 1) / n, np.log1p(len(found)), *meta,
    ]
    x = counts / np.sqrt(float((counts * counts).sum())) if len(counts) else np.empty(0)
    return found, x, [float(s) for s in statistics]


@dataclass
class Model:
    edges: np.ndarray  # statistic x (bins - 1)
    bias: float
    weight: np.ndarray  # buckets + statistics * bins
    factor: np.ndarray  # the same x rank

    def indices(self, statistics: np.ndarray) -> np.ndarray:
        """Indicator features of rows of statistics."""
        bins = np.stack([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, statistics.T)], axis=1)
        return BUCKETS + np.arange(statistics.shape[1]) * BINS + bins

    def raw(self, index: np.ndarray, x: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of rows and the factor sums, from flat features sorted by row."""
        starts = np.searchsorted(row, np.arange(rows))
        linear = np.add.reduceat(self.weight[index] * x, starts)
        vx = self.factor[index] * x[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, found: list) -> np.ndarray:
        index, x, row = flatten(self, found)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, x, row, len(found))[0], -30, 30)))


def flatten(model: Model, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' features one after the other: index, value, row. Every row has its indicators at least."""
    own = model.indices(np.array([f[2] for f in found]))
    scale = 1 / np.sqrt(own.shape[1])
    index = np.concatenate([a for f, o in zip(found, own) for a in (f[0], o)])
    x = np.concatenate([a for f in found for a in (f[1], np.full(own.shape[1], scale))])
    sizes = np.array([len(f[0]) + own.shape[1] for f in found])
    return index, x, np.repeat(np.arange(len(found)), sizes)


def fit(found: list, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.03, decay: float = 1e-4, seed: int = 11) -> Model:
    """Logistic loss by Adam over small batches."""
    rng = np.random.default_rng(seed)
    statistics = np.array([f[2] for f in found])
    edges = np.quantile(statistics, np.arange(1, BINS) / BINS, axis=0).T
    low, high = statistics.min(axis=0), statistics.max(axis=0)
    for s in range(len(edges)):  # quantiles that coincide give way to even steps above them, where rare values lie
        if len(np.unique(edges[s])) < BINS - 1:
            edges[s] = np.sort(np.concatenate([np.unique(edges[s]), np.linspace(low[s], high[s] + 1e-9, BINS + 1)[1:]])[-(BINS - 1) :])
    size = BUCKETS + statistics.shape[1] * BINS
    model = Model(edges, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    state = [np.zeros((size, RANK + 1)), np.zeros((size, RANK + 1))]
    step, mean, var = 0, 0.0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            index, x, row = flatten(model, [found[j] for j in pick])
            out, sums = model.raw(index, x, row, len(pick))
            slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[pick]) / len(pick)
            own = slope[row] * x
            grads = np.concatenate([own[:, None], own[:, None] * (sums[row] - self_part(model, index, x))], axis=1)
            used, where = np.unique(index, return_inverse=True)
            total = np.zeros((len(used), RANK + 1))
            np.add.at(total, where, grads)
            values = np.concatenate([model.weight[used, None], model.factor[used]], axis=1)
            total += decay * values
            step += 1
            state[0][used] = 0.9 * state[0][used] + 0.1 * total
            state[1][used] = 0.99 * state[1][used] + 0.01 * total * total
            values -= rate * state[0][used] / (1 - 0.9**step) / (np.sqrt(state[1][used] / (1 - 0.99**step)) + 1e-8)
            model.weight[used], model.factor[used] = values[:, 0], values[:, 1:]
            g = float(slope.sum())
            mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
            model.bias -= rate * mean / (1 - 0.9**step) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return model


def self_part(model: Model, index: np.ndarray, x: np.ndarray) -> np.ndarray:
    return model.factor[index] * x[:, None]


def _meta(columns: list[list]) -> list[list[float]]:
    return [[float(np.log1p(max(0.0, float(v or 0)))) for v in row] for row in zip(*columns)]


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: list[str], label_col: str, held_out: int, sample: int) -> Model | None:
    """The machine, fitted on at most `sample` labelled documents whose crc32(id) mod `held_out` is not 0."""
    chosen = labels.filter(F.col(label_col).isNotNull() & (crc_remainder(id_col, held_out) != 0)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("_id"), "_label")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(meta_cols)))
    rows = own.join(F.broadcast(chosen), "_id")

    def run(batches):
        buckets = Buckets()
        for batch in slices(batches, 200):
            columns = [c.to_pylist() for c in batch.columns]
            metas = _meta(columns[3:-1]) if meta_cols else [[]] * len(columns[0])
            found = [features(t, m, buckets) for t, m in zip(columns[1], metas)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[2], pa.int64()), pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.list_(pa.float64())), pa.array(columns[-1], pa.float64())],
                names=["key", "found", "x", "statistics", "label"],
            )

    picked = rows.select("_id", "_text", F.xxhash64("_id").alias("key"), *(f"_m{i}" for i in range(len(meta_cols))), F.col("_label").cast("double"))
    got = map_arrow(picked, run, "key long, found array<long>, x array<double>, statistics array<double>, label double").limit(2 * sample).collect()
    got.sort(key=lambda r: (r["key"], r["statistics"]))
    y = np.array([r["label"] for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return fit([(np.array(r["found"], np.int64), np.array(r["x"]), r["statistics"]) for r in got], (y > 0).astype(float))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), label_col: str = "quality", held_out: int = 5, sample: int = 6000, name: str = "_score") -> DataFrame:
    """`docs` with a score from 0 to 1 as last column `name`. `sample` bounds the labelled rows that the machine is fitted on."""
    metas = [c for c in meta_cols if c in docs.columns]
    model = train(docs, labels, id_col, text_col, metas, label_col, held_out, sample)
    places = [docs.columns.index(c) for c in (text_col, *metas)]

    def run(batches):
        buckets = Buckets()
        for batch in slices(batches, 500):
            texts, *columns = ([v.as_py() for v in batch.column(i)] for i in places)
            rows = _meta(columns) if columns else [[]] * len(texts)
            scores = model.score([features(t, m, buckets) for t, m in zip(texts, rows)]) if model and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*(f"c{i}" for i in range(batch.num_columns)), "score"])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)), "score double"])
    return map_arrow(numbered(docs), run, schema).toDF(*docs.columns, name)


THRESHOLD = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = scored(docs, read_table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted")
    )


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
