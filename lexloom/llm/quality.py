"""Quality classifier: random-indexing word vectors pooled per text, then a two-layer network.

Every word falls into one of a fixed number of buckets by its hash and has a sparse random index vector. A
bucket's context vector is the sum of the index vectors around its words over the whole
corpus. A text is the mean of its words' vectors with a few plain measures beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.labelled import fold, one_per_document, summed, training_rows
from lexloom.llm.words import Words, pieces, split_classes, split_words

PIECE = 512 << 10


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows the network is fitted on; word vectors use every text."""

    buckets: int = 1 << 13
    size: int = 48
    window: int = 2
    sample: int = 8000
    hidden: int = 32
    epochs: int = 60
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 11


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the two places of its index vector and their signs."""
    random = np.random.default_rng(s.seed)
    return random.integers(0, s.size, (s.buckets, 2)), random.choice([-1, 1], (s.buckets, 2))


def _buckets(words: Words, s: Settings) -> np.ndarray:
    return (words.hashes() % np.uint64(s.buckets)).astype(np.int64)


def _context_sums(s: Settings):
    places, signs = index_vectors(s)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(s.buckets * s.size, np.int64)
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                words = split_classes(batch.column(0))
                bucket, row = _buckets(words, s), words.row
                for step in range(1, s.window + 1):
                    near = row[step:] == row[:-step]
                    left, right = bucket[:-step][near], bucket[step:][near]
                    for one, other in ((left, right), (right, left)):
                        for j in range(2):
                            flat = one * s.size + places[other, j]
                            total += np.bincount(flat, weights=signs[other, j], minlength=len(total)).astype(np.int64)
        return total

    return run


def word_vectors(documents: DataFrame, text: str = "text", s: Settings = Settings()) -> np.ndarray:
    """Unit context vector plus half the unit index vector of each bucket, over all texts."""
    rows = documents.select(F.col(text).alias("text"))
    sums = summed(rows, _context_sums(s), s.buckets * s.size).reshape(s.buckets, s.size).astype(np.float64)
    sums -= sums.mean(0)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
    places, signs = index_vectors(s)
    for j in range(2):
        np.add.at(vectors, (np.arange(s.buckets), places[:, j]), 0.5 * signs[:, j] / 2**0.5)
    return vectors.astype(np.float32)


N_MEASURES = 6


def text_features(texts: pa.Array, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Pooled word vector and measures of each text; an empty text has zeros."""
    words = split_classes(texts)
    count, firsts = words.counts(), words.firsts()
    out = np.zeros((words.n_rows, s.size + N_MEASURES), np.float32)
    filled = np.flatnonzero(count > 0)
    if not len(filled):
        return out
    pooled = np.add.reduceat(vectors[_buckets(words, s)], firsts[filled], axis=0)
    out[filled, : s.size] = pooled / count[filled, None]

    plain = split_words(texts, lower=False)
    n, hashes, row = np.maximum(plain.counts(), 1), plain.hashes(), plain.row
    same = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    order = np.lexsort((hashes, row))
    again = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    data = words.data
    in_row = np.repeat(np.arange(words.n_rows), np.diff(words.offsets))
    size = np.maximum(np.diff(words.offsets), 1)
    share = lambda mask: np.bincount(in_row[mask], minlength=words.n_rows) / size
    upper = (data >= 65) & (data <= 90)
    sign = (data > 32) & (data < 127) & ~upper & ~((data >= 48) & (data <= 57)) & ~((data >= 97) & (data <= 122))
    measures = [
        np.bincount(row[1:][same], minlength=words.n_rows) / n,
        np.bincount(row[order][1:][again], minlength=words.n_rows) / n,
        share(upper),
        share(sign),
        share((data >= 48) & (data <= 57)),
        np.log1p(plain.counts()) / 5,
    ]
    out[:, s.size :] = np.stack(measures, axis=1)
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` scales the logit."""

    mean: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((features - self.mean) / self.spread) @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features.astype(np.float64)) / self.temperature, -50, 50)))


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


def fit_network(features: np.ndarray, labels: np.ndarray, s: Settings) -> Network:
    """Adam on four fifths of the rows; the temperature is chosen on the rest.

    Without rows of both classes the network is constant: its probability is the share of
    label 1 with one row of each class added.
    """
    n, width = features.shape
    random = np.random.default_rng(s.seed)
    mean = features.mean(0, dtype=np.float64) if n else np.zeros(width)
    spread = features.std(0, dtype=np.float64) + 1e-3 if n else np.ones(width)
    net = Network(mean, spread, random.normal(0, (2 / width) ** 0.5, (width, s.hidden)), np.zeros(s.hidden),
                  random.normal(0, (1 / s.hidden) ** 0.5, s.hidden), 0.0)
    if labels.sum() in (0, n):
        net.second[:] = 0
        net.second_bias = float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
        return net
    order = random.permutation(n)
    kept, rest = order[: n // 5], order[n // 5 :]
    x, y = (features[rest].astype(np.float64) - mean) / spread, labels[rest].astype(np.float64)
    weights = [net.first, net.first_bias, net.second, np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs) + 1e-4
        for at in range(0, len(y), s.batch):
            part = slice(at, at + s.batch)
            raw = x[part] @ weights[0] + weights[1]
            hidden = np.maximum(raw, 0)
            logit = hidden @ weights[2] + weights[3]
            error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[part]) / len(logit)
            back = np.outer(error, weights[2]) * (raw > 0)
            gradients = [x[part].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True)]
            step += 1
            for w, g, (m, v) in zip(weights, gradients, moments, strict=True):
                g += s.decay * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        mixed = random.permutation(len(y))
        x, y = x[mixed], y[mixed]
    net.second_bias = float(weights[3][0])
    logits = net.logits(features[kept].astype(np.float64))
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    net.temperature = float(min(grid, key=lambda t: _loss(logits / t, labels[kept])))
    return net


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray
    network: Network

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.network.probabilities(text_features(texts, self.vectors, self.settings))


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, s: Settings = Settings()
) -> Model:
    """Word vectors of all texts, and a network fitted on labels outside the held-out fold.

    Null texts count as empty. Of rows that share a key one text is learned from, the same whenever this runs; repeated rows count as often
    as they stand there for the word vectors. Contradicting labels: the smaller; labels other than 0 and 1, of unknown keys or null keys are
    left out. Without labels of both classes every text gets the same score.
    """
    vectors = word_vectors(documents, "text", s)
    chosen = training_rows(documents, labels, label, folds, held_out, s.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                features = text_features(batch.column(1), vectors, s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(3), batch.column(2), pa.array([f.tobytes() for f in features], pa.binary())],
                    ["doc_id", "text_hash", "label", "features"],
                )

    rows = one_per_document(chosen.mapInArrow(run, "doc_id long, text_hash long, label int, features binary"))
    found = sorted(rows.collect())
    features = np.array([np.frombuffer(r["features"], np.float32) for r in found]).reshape(len(found), s.size + N_MEASURES)
    return Model(s, vectors, fit_network(features, np.array([r["label"] for r in found], np.int64), s))


def score(documents: DataFrame, model, text: str = "text", column: str = "score") -> DataFrame:
    """The input's columns and the model's probability for each text, in the task that scans it.

    Works for any model with ``score(texts)``. Null and empty texts are scored like any text
    without words. Repeated rows get equal scores. A column of that name is replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.drop(column)
    kept, names = source.columns, [*source.columns, column]
    schema = T.StructType([*source.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = kept.index(text)
        for whole in batches:
            whole = whole.rename_columns([str(i) for i in range(whole.num_columns)])
            for batch in pieces(whole, str(place), PIECE):
                found = pa.array(np.asarray(sent.value.score(batch.column(place)), np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    return source.mapInArrow(run, schema)


def classify_quality(
    documents: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.7
) -> DataFrame:
    """Score every text: the input's columns, ``held_out``, ``score`` and ``predicted`` (1 from the threshold on).

    Labels are used only outside the fold crc32(doc_id) mod 4 = 2. See ``fit`` and ``score`` for how
    nulls, empty texts, repeated rows and missing labels are treated; an empty table gives no rows.
    """
    scored = score(documents, fit(documents, labels, s=s))
    return scored.withColumns(
        {
            "held_out": F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)),
            "predicted": (F.col("score") >= threshold).cast("int"),
        }
    )
