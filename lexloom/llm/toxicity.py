"""Toxicity: a linear classifier whose scores change little when identity terms are swapped.

Features say which hashed words and word beginnings occur in a text: at all, twice, four
times, or as one word in a hundred. For labelled texts with
identity terms counterparts are made in which each term gives way to the next of its list, to the one after that, and so on; the
squared differences of the scores are part of the loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.labelled import fold, one_per_document, summed, training_rows
from lexloom.llm.quality import score
from lexloom.llm.words import Words, _runs, lower_ascii, pieces, text_buffers

# Identity terms by kind, in the languages of the tables; a term is swapped for the others of its line.
IDENTITY_TERMS = (
    "christian muslim jewish hindu buddhist sikh atheist catholic",
    "christians muslims jews hindus buddhists sikhs atheists catholics",
    "black white asian latino african european arab indian",
    "gay straight lesbian bisexual trans queer",
    "men women girls boys",
    "man woman girl boy",
    "immigrant refugee foreigner migrant",
    "immigrants refugees foreigners migrants",
    "deaf blind disabled autistic",
    "chrétien musulman juif hindou bouddhiste athée catholique",
    "hommes femmes filles garçons",
    "immigrés réfugiés étrangers migrants",
    "christ muslim jude hinduist buddhist atheist katholik",
    "männer frauen mädchen jungen",
    "einwanderer flüchtlinge ausländer migranten",
    "cristiano musulmán judío hindú budista ateo católico",
    "hombres mujeres niñas niños",
    "inmigrantes refugiados extranjeros migrantes",
)
HEADS = (None, 4, 6, 8)
LEVELS = 4
PIECE = 512 << 10


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows, ``features`` the hashed features that are kept for the fit."""

    buckets: int = 1 << 16
    features: int = 2048
    sample: int = 10000
    least_texts: int = 3
    penalty: float = 10.0
    decay: float = 2e-4
    rounds: int = 300
    terms: tuple[str, ...] = IDENTITY_TERMS

    @property
    def total(self) -> int:
        return LEVELS * self.buckets


def letter_words(texts: pa.Array) -> Words:
    """Runs of letters and apostrophes, A-Z in lower case."""
    data, offsets = text_buffers(texts)
    data = lower_ascii(data)
    start, end = _runs((data >= 128) | ((data >= 97) & (data <= 122)) | (data == 39), offsets)
    return Words(data, offsets, np.searchsorted(offsets, start, side="right") - 1, start, end, len(texts))


def _hashed(words: Words, s: Settings) -> np.ndarray:
    """Feature numbers of each word: the word itself and its beginnings."""
    every = [words.hashes(h) + np.uint64(0 if h is None else h) for h in HEADS]
    return np.stack([(x % np.uint64(s.buckets)).astype(np.int64) for x in every], axis=1)


def swaps(s: Settings, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the identity terms, and the features of what each is swapped for: the term ``step`` places on in its line.

    A term that stands in several lines is swapped within the first. Where a line has no other term so far on, a term stays.
    """
    pairs: dict[str, str] = {}
    for line in s.terms:
        group = line.split()
        for i, term in enumerate(group):
            pairs.setdefault(term, group[(i + step) % len(group)] if step < len(group) else term)
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros((0, len(HEADS)), np.int64)
    known = letter_words(pa.array(list(pairs))).hashes()
    features = _hashed(letter_words(pa.array(list(pairs.values()))), s)
    order = np.argsort(known)
    return known[order], features[order]


def steps(s: Settings) -> range:
    """How many places on the terms of a line can be swapped for another."""
    return range(1, max((len(line.split()) for line in s.terms), default=1))


def text_features(texts: pa.Array, s: Settings, step: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each feature that occurs, without repeats; rows with a term that is swapped.

    A hashed word or beginning has one feature for each of ``LEVELS`` ways to occur. With ``step``,
    the features of the counterparts that far on.
    """
    words = letter_words(texts)
    number = _hashed(words, s)
    named = np.zeros(len(words.row), bool)
    if step:
        known, features = swaps(s, step)
        hashes = words.hashes()
        place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        named = known[place] == hashes if len(known) else named
        swapped = features[place[named]] if len(known) else number[named]
        changes = (swapped != number[named]).any(axis=1)
        number[named] = swapped
        named[named] = changes
    pairs, times = np.unique((words.row[:, None] * s.buckets + number).ravel(), return_counts=True)
    row, number = pairs // s.buckets, pairs % s.buckets
    levels = (times >= 1, times >= 2, times >= 4, 100 * times >= words.counts()[row])
    return (
        np.concatenate([row[on] for on in levels]),
        np.concatenate([number[on] + i * s.buckets for i, on in enumerate(levels)]),
        np.unique(words.row[named]),
    )


def _document_counts(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * s.total + 2, np.int64)
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                label = batch.column(2).to_numpy().astype(np.int64)
                row, number, _ = text_features(batch.column(1), s)
                total[:-2] += np.bincount(label[row] * s.total + number, minlength=2 * s.total)
                total[-2:] += np.bincount(label, minlength=2)
        return total

    return run


def telling_features(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features whose rates differ most between the classes, in standard errors, and
    the size of each one's log ratio of rates, by which it is scaled for the fit."""
    without, with_ = counts[: s.total].astype(float), counts[s.total : -2].astype(float)
    n0, n1 = counts[-2:] + 1.0
    ratio = np.log((with_ + 0.5) / n1) - np.log((without + 0.5) / n0)
    error = np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5))
    strength = np.where(with_ + without >= s.least_texts, np.abs(ratio) / error, 0)
    best = np.argsort(-strength, kind="stable")[: s.features]
    best = np.sort(best[strength[best] > 1.0])
    return best, np.abs(ratio[best])


@dataclass
class Model:
    settings: Settings
    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    with_counterparts: int = 0  # labelled rows that hold an identity term

    def score(self, texts: pa.Array) -> np.ndarray:
        row, number, _ = text_features(texts, self.settings)
        full = np.zeros(self.settings.total)
        full[self.chosen] = self.weights
        logit = np.bincount(row, weights=full[number], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_weights(x: np.ndarray, y: np.ndarray, change: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression with the mean squared score change of ``change`` rows as a penalty.

    Gradient descent with momentum; the step is one over a bound of the curvature. Without rows of
    both classes all weights are 0 and the bias gives the share of label 1, one row of each class added.
    """
    n, width = x.shape
    weights = np.zeros(width)
    if y.sum() in (0, n):
        return weights, float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    far = change.astype(np.float64).T @ change / max(len(change), 1) * (2 * s.penalty)
    curve = 0.25 * (_largest(x, n) + 1) + s.decay + (np.linalg.eigvalsh(far)[-1] if len(change) else 0)
    speed, bias_speed = np.zeros(width), 0.0
    for number in range(s.rounds):
        keep = number / (number + 3)
        ahead, bias_ahead = weights + keep * speed, bias + keep * bias_speed
        error = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32) + bias_ahead, -50, 50))) - y
        gradient = (error.astype(np.float32) @ x) / n + s.decay * ahead + far @ ahead
        new, new_bias = ahead - gradient / curve, bias_ahead - error.mean() / curve
        speed, bias_speed = new - weights, new_bias - bias
        weights, bias = new, new_bias
    return weights, float(bias)


def _largest(x: np.ndarray, n: int) -> float:
    """Largest eigenvalue of x'x / n, by power iteration."""
    v = np.ones(x.shape[1], np.float32) / max(x.shape[1], 1) ** 0.5
    value = 0.0
    for _ in range(20):
        v = (x @ v) @ x / n
        value = float(np.linalg.norm(v))
        if value == 0:
            return 0.0
        v /= value
    return 1.1 * value


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, s: Settings = Settings()
) -> Model:
    """A model of the labels outside the held-out fold, from at most ``s.sample`` labelled rows.

    Null texts count as empty. Of rows that share a key one text is learned from, the same whenever this runs. Contradicting
    labels: the smaller; labels other than 0 and 1, of unknown keys or null keys are left out. A text without identity terms has no
    counterpart: if none has one, the model is a plain logistic regression.
    """
    rows = training_rows(documents, labels, label, folds, held_out, s.sample)
    chosen, scale = telling_features(summed(rows, _document_counts(s), 2 * s.total + 2), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(texts: pa.Array, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
            row, number, named = text_features(texts, s, step)
            place = np.minimum(np.searchsorted(chosen, number), max(len(chosen) - 1, 0))
            hit = chosen[place] == number if len(chosen) else np.zeros(len(number), bool)
            bits = np.zeros((len(texts), len(chosen)), bool)
            bits[row[hit], place[hit]] = True
            return np.packbits(bits, axis=1), named

        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                texts = batch.column(1)
                own, _ = packed(texts)
                others: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
                # a first look at step 1 tells which few texts hold a term at all
                holders = text_features(texts, s, 1)[2] if len(steps(s)) else np.zeros(0, np.int64)
                for step in steps(s) if len(holders) else ():
                    bits, named = packed(texts.take(pa.array(holders)), step)
                    for i in named:
                        others[holders[i]].append(bits[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(3), batch.column(2), pa.array([b.tobytes() for b in own], pa.binary()), pa.array(others, pa.list_(pa.binary()))],
                    ["doc_id", "text_hash", "label", "own", "swapped"],
                )

    made = rows.mapInArrow(run, "doc_id long, text_hash long, label int, own binary, swapped array<binary>")
    found = sorted(one_per_document(made).collect(), key=lambda r: r["doc_id"])
    bits = lambda raws: np.unpackbits(
        np.array([np.frombuffer(r, np.uint8) for r in raws], np.uint8).reshape(len(raws), -(-len(chosen) // 8)), axis=1, count=len(chosen)
    ).astype(np.float32)
    x, y = bits([r["own"] for r in found]), np.array([r["label"] for r in found], np.float64)
    twins = [(r["own"], other) for r in found for other in r["swapped"]]
    change = bits([own for own, _ in twins]) - bits([other for _, other in twins])
    scale = scale.astype(np.float32)
    weights, bias = fit_weights(x * scale, y, change * scale, s)
    return Model(s, chosen, weights * scale, bias, sum(bool(r["swapped"]) for r in found))


def classify_toxicity(
    documents: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.5
) -> DataFrame:
    """Score every text: the input's columns, ``held_out``, ``score`` and ``predicted`` (1 from the threshold on).

    Labels are used only outside the fold crc32(doc_id) mod 5 = 0; see ``fit`` for rows that share a key. Null and empty texts have no features and get the
    score of the bias; repeated rows get equal scores; without labels of both
    classes every score is the same. An empty table gives no rows.
    """
    scored = score(documents, fit(documents, labels, s=s))
    return scored.withColumns(
        {
            "held_out": F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)),
            "predicted": (F.col("score") >= threshold).cast("int"),
        }
    )
