"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise sum is taken in linear time: half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2, summed over the factors.

Features of a text: its distinct words, hashed (together of length one); statistics of its structure (symbols, capitals,
digits, repeats, lines), each as one of sixteen intervals; its size the same way.  Intervals are quantiles of the sample,
so pairs of intervals and words interact.  Learning takes a bounded sample of labelled rows: at most ``per_class`` of each
label, the least by hash, weighed back to the labels' true shares.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, fold, kept, slices, texts_of

FOLDS = 5
THRESHOLD = 0.3
PER_CLASS = 1000
FACTORS = 8
BUCKETS = 1 << 14
BINS = 16
STATISTICS = (
    "letters", "capitals", "digits", "symbols", "marks", "bars", "shouted", "symbol_words", "digit_words", "mean_length", "distinct", "repeats",
    "top_word", "line_repeats", "worst_line", "words", "characters", "lines", "line_length", "long_words",
)
#: Words whose bucket and marks a worker remembers, twice.
REMEMBERED = 150_000
#: Characters of a word whose counts fit the eight bits they are packed in.
PACKED = 255
PUNCTUATION = frozenset(".,;:'\"-()?’“”")


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # (statistics, BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _marks(word: str) -> tuple[int, ...]:
    """Bucket, letters, capitals, digits, symbols, length and marks of a whole word."""
    letters = sum(c.isalpha() for c in word)
    capitals = sum(c.isupper() for c in word)
    digits = sum(c.isdigit() for c in word)
    symbols = sum(not c.isalnum() and c not in PUNCTUATION for c in word)
    ends = 1 * (symbols >= 2) | 2 * (capitals >= 2 and capitals == letters) | 4 * (digits > 0) | 8 * (word == "|") | 16 * word.endswith("!!") | 32 * (len(word) > 30)
    bucket = xxhash.xxh32_intdigest(word.lower().strip(".,;:!?\"'()")) % BUCKETS
    return bucket, letters, capitals, digits, symbols, len(word), ends


def _word(word: str) -> int:
    """A word of up to ``PACKED`` characters: bucket | letters << 16 | capitals << 24 | digits << 32 | symbols << 40 | length << 48 | marks << 56."""
    bucket, letters, capitals, digits, symbols, length, ends = _marks(word)
    return bucket | letters << 16 | capitals << 24 | digits << 32 | symbols << 40 | length << 48 | ends << 56


def _packed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words packed, and the counts (letters to length) of longer ones, which are packed without counts and not remembered."""
    wide = [k for k, w in enumerate(words) if len(w) > PACKED] if max(map(len, words)) > PACKED else []
    told = [_marks(words[k]) for k in wide]
    if wide:
        words = [w if len(w) <= PACKED else "" for w in words]
    known = kept("quality words", lambda: Recent(REMEMBERED))
    for w in known.missing(set(words)):
        known[w] = _word(w)
    packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    for k, (bucket, *_, ends) in zip(wide, told):
        packed[k] = bucket | ends << 56
    return packed, np.array([t[1:6] for t in told], np.int64).reshape(-1, 5).sum(axis=0)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, and the statistics.  An empty text has no bucket and zeros."""
    words = text.split()
    lines = text.split("\n")
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(STATISTICS))
    packed, more = _packed(words)
    letters, capitals, digits, symbols, length = ((packed >> s & 255).sum() + m for s, m in zip((16, 24, 32, 40, 48), more))
    ends = packed >> 56
    symbolic = ends & 1
    bucket = packed & (BUCKETS - 1)
    distinct, counts = np.unique(bucket, return_counts=True)
    sizes = np.array([len(line.split()) for line in lines])
    odd = (symbolic | (ends >> 1 & 1) | (ends >> 3 & 1))
    odd[1:] |= bucket[1:] == bucket[:-1]
    by_line = np.add.reduceat(np.r_[odd, 0], np.minimum(np.r_[0, np.cumsum(sizes)[:-1]], n)) / np.maximum(sizes, 1)
    worst = float(by_line[sizes >= 3].max(initial=0.0))
    total = max(1, length)
    stats = (
        letters / total, capitals / max(1, letters), digits / total, symbols / total, (ends >> 4 & 1).mean(), (ends >> 3 & 1).mean(), (ends >> 1 & 1).mean(),
        symbolic.mean(), (ends >> 2 & 1).mean(), length / n, len(distinct) / n, (bucket[1:] == bucket[:-1]).sum() / n,
        counts.max() / n, 1 - len(set(lines)) / len(lines), worst, np.log1p(n), np.log1p(len(text)), np.log1p(len(lines)), np.log1p(len(text) / len(lines)), (ends >> 5 & 1).mean(),
    )
    return distinct, np.array(stats, float)


def indices(model_edges: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Feature numbers of statistics: one interval each, behind the buckets."""
    return BUCKETS + np.array([k * BINS + np.searchsorted(model_edges[k], x, side="right") for k, x in enumerate(stats)], np.int64)


def _rows(words: list[np.ndarray], stats: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature numbers, values and starts."""
    bins = np.stack([np.searchsorted(edges[k], stats[:, k], side="right") for k in range(len(edges))], axis=1) + np.arange(len(edges)) * BINS + BUCKETS
    sizes = np.array([len(w) for w in words])
    index = np.concatenate([np.concatenate([w, b]) for w, b in zip(words, bins)])
    value = np.concatenate([np.r_[np.full(n, 1 / np.sqrt(max(1, n))), np.full(len(edges), 0.5)] for n in sizes])
    starts = np.r_[0, np.cumsum(sizes + len(edges))[:-1]]
    return index, value, starts


def margins(model: Model, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    vx = model.factors[index] * value[:, None]
    sums = np.add.reduceat(vx, starts)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    return model.bias + np.add.reduceat(model.linear[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def fit(words: list[np.ndarray], stats: np.ndarray, label: np.ndarray, weight: np.ndarray, factors: int = FACTORS, rounds: int = 40, rate: float = 0.1, l2: float = 2e-4) -> Model:
    """Adam on the weighted log loss over the whole sample, from a fixed seed."""
    size = BUCKETS + len(STATISTICS) * BINS
    rng = np.random.default_rng(7)
    if not len(label):
        edges = np.zeros((len(STATISTICS), BINS - 1))
        return Model(edges, 0.0, np.zeros(size), np.zeros((size, factors)))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    index, value, starts = _rows(words, stats, edges)
    value = value.astype(np.float32)
    row = np.repeat(np.arange(len(label)), np.diff(np.r_[starts, len(index)]))
    order = np.argsort(index, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0])
    used, at = np.unique(index, return_inverse=True)  # only features of the sample move
    share = np.clip((weight * label).sum() / weight.sum(), 0.01, 0.99)
    bias = np.array([np.log(share / (1 - share))])
    linear = np.zeros(len(used), np.float32)
    pair = rng.normal(0, 0.02, (len(used), factors)).astype(np.float32)
    weight = weight / weight.sum()
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (bias, linear, pair)]
    for t in range(1, rounds + 1):
        vx = pair[at] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        z = bias[0] + np.add.reduceat(linear[at] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        slope = (error[row] * value).astype(np.float32)
        slopes = (
            np.array([error.sum()]),
            np.add.reduceat(slope[order], heads) + l2 * linear,
            np.add.reduceat((slope[:, None] * (sums[row] - vx))[order], heads) + l2 * pair,
        )
        for (m, s), g, x in zip(state, slopes, (bias, linear, pair)):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    model = Model(edges, float(bias[0]), np.zeros(size), np.zeros((size, factors)))
    model.linear[used], model.factors[used] = linear, pair
    return model


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return fold(doc_id) % folds == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` rows of each label outside the held-out fold; rows with a null id or label are left out.

    The sample's ids (bounded) are broadcast, so texts do not move; their features, not the texts, come to the driver.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().where(~held_out(F.col("doc_id")))
    totals = {r["label"]: r["count"] for r in known.where("label in (0, 1)").groupBy("label").count().collect()}
    sample = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [features(t) for t in texts_of(batch)]
            arrays = [batch.column("doc_id"), batch.column("label"), pa.array([w.astype(np.int32) for w, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "words", "stats"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample[0].union(sample[1])), "doc_id")
    rows = sorted(chosen.mapInArrow(described, "doc_id long, label int, words array<int>, stats array<double>").collect(), key=lambda r: (r.doc_id, r.label, r.words))
    label = np.array([r.label for r in rows], float)
    share = {y: totals.get(y, 0) / max(1, int((label == y).sum())) for y in (0, 1)}
    words = [np.array(r.words, np.int64) for r in rows]
    stats = np.array([r.stats for r in rows], float).reshape(-1, len(STATISTICS))
    return fit(words, stats, label, np.array([share[int(y)] for y in label]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1, higher for label 1.  Null and empty texts are scored by their missing words.

    An older column ``name`` is replaced; all others pass through.
    """
    # a tuple: broadcast values are pickled by reference, and executors need not have this package
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.bias, model.linear, model.factors))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in slices(batches):
            got = [features(t) for t in texts_of(batch, text_col)]
            z = margins(model, *_rows([w for w, _ in got], np.array([s for _, s in got]), model.edges))
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

    rows = docs.drop(name)
    return rows.mapInArrow(scored, T.StructType([*rows.schema, T.StructField(name, T.DoubleType())]))
