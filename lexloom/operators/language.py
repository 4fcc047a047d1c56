"""Language detection by trigram profile and script, and the language-match score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.languages import UNKNOWN, iso_code, script_language
from lexloom.session import spread_small_input, written
from lexloom.sources.versions import VersionedTable

# Log-probabilities are kept as whole numbers of this size, so that sums do not
# depend on the order in which partial sums meet.
LOG_UNIT = 1_000_000
MAX_LANGUAGES = 100


def trigrams(text: Column) -> Column:
    """All overlapping runs of three characters, found in one pass over the text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(...))."), F.lit(1))


@dataclass(frozen=True)
class Profile:
    """One row per known trigram with a log-probability column per language.

    ``rows`` has at most ``top_n`` times the number of languages rows.
    """

    rows: DataFrame
    languages: tuple[str, ...]


def _weight(language: str) -> str:
    return f"log_{language}"


def _checked(languages: Sequence[str]) -> tuple[str, ...]:
    languages = tuple(sorted(languages))
    if not 0 < len(languages) <= MAX_LANGUAGES:
        raise ValueError(f"between 1 and {MAX_LANGUAGES} languages expected, got {len(languages)}")
    return languages


def count_trigrams(labelled: DataFrame, text: str, label: str, languages: Sequence[str]) -> DataFrame:
    """``gram`` and its number of occurrences in each of the given languages. Rows with another label are not used.

    Counts of several batches add up: see :func:`merge_counts`.
    """
    languages = _checked(languages)
    used = labelled.select(label, text).where(F.col(label).isin(*languages))
    grams = spread_small_input(used).select(F.col(label).alias("language"), F.explode(trigrams(F.col(text))).alias("gram"))
    return grams.groupBy("gram").agg(*[F.count_if(F.col("language") == code).alias(code) for code in languages])


def merge_counts(counts: DataFrame) -> DataFrame:
    """One row per trigram from the counts of any number of batches, which need not know the same languages."""
    codes = [name for name in counts.columns if name != "gram"]
    return counts.groupBy("gram").agg(*[F.sum(F.coalesce(code, F.lit(0))).alias(code) for code in codes])


def profile_of_counts(counts: DataFrame, top_n: int = 300) -> Profile:
    """The profile that trigram counts give: every trigram that is among the ``top_n`` of some language, equal
    counts resolved by trigram. ``counts`` is read several times: pass a written table."""
    languages = _checked([name for name in counts.columns if name != "gram"])
    each = F.array(*[F.struct(F.lit(code).alias("language"), F.col(code).alias("n")) for code in languages])
    long_ = counts.select("gram", F.explode(each).alias("c")).select("gram", "c.language", "c.n").where("n > 0")
    order = Window.partitionBy("language").orderBy(F.col("n").desc(), "gram")
    kept = long_.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n).select("gram")
    totals = counts.agg(*[F.sum(code).alias(code) for code in languages]).first()
    rows = counts.join(F.broadcast(kept.distinct()), "gram", "left_semi").select(
        "gram",
        *[
            F.round(F.log((F.col(code) + 0.5) / F.lit(float(totals[code] or 1))) * LOG_UNIT)
            .cast("long")
            .alias(_weight(code))
            for code in languages
        ],
    )
    return Profile(rows, languages)


def train_profile(
    labelled: DataFrame, text: str, label: str, languages: Sequence[str], top_n: int = 300
) -> Profile:
    """Learn the most frequent trigrams of each of the given languages.

    The counts (one row per trigram, one column per language) are written once to the shared folder.
    """
    return profile_of_counts(written(count_trigrams(labelled, text, label, languages), "trigram-counts"), top_n)


class ProfileStore:
    """Trigram counts of batches and the profiles made of them, kept in ``folder``.

    A batch that is learned again under its name takes the place of its former counts, so a repeated job does not
    count twice. Profiles are versions: detection that began with one keeps it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._profiles = VersionedTable(spark, f"{self.folder}/profiles")

    def _batch(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/counts/{name}")

    def learn(self, batch: str, labelled: DataFrame, text: str, label: str, languages: Sequence[str]) -> None:
        """Count the trigrams of a batch and keep the counts; its texts are not needed again."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a name for a batch: {batch!r}")
        self._batch(batch).write(count_trigrams(labelled, text, label, languages))

    def batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/counts")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(name for name in names if self._batch(name).current() is not None)

    def build(self, top_n: int = 300) -> int:
        """Make a profile of all batches' counts and keep it; the number of its version."""
        counts = [self._batch(name).read() for name in self.batches()]
        if not counts:
            raise ValueError("nothing was learned yet")
        merged = merge_counts(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts))
        made = profile_of_counts(written(merged, "trigram-counts"), top_n)
        properties = {"languages": ",".join(made.languages), "top_n": str(top_n)}
        return self._profiles.write(made.rows, properties=properties).number

    def load(self, version: int | None = None) -> Profile:
        """A stored profile, the latest unless one is named; nothing is trained."""
        held = self._profiles.version(version)
        return Profile(self._profiles.read(held.number), tuple(held.properties["languages"].split(",")))


def _gram_codes(text: str) -> np.ndarray:
    """Every trigram of a text as one number: three code points of 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return points[:-2] | points[1:-1] << np.uint64(21) | points[2:] << np.uint64(42)


def _parts(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters together."""
    begin, size = 0, 0
    for place, body in enumerate(texts):
        if size and size + len(body) > most:
            yield texts[begin:place]
            begin, size = place, 0
        size += len(body)
    yield texts[begin:]


def _part_sums(texts: list[str], codes: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Known trigrams of each text, and the sum of their logs per language, in one pass over all texts."""
    n, sizes = len(texts), np.array([len(body) for body in texts], np.int64)
    joined = "\0".join(texts)
    totals = np.zeros((n, logs.shape[1]), np.int64)
    if len(joined) < 3 or not len(codes):
        return np.zeros(n, np.int64), totals
    grams = _gram_codes(joined)
    row = np.repeat(np.arange(n), sizes + 1)[: len(grams)]
    ends = np.cumsum(sizes + 1) - 1
    place = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
    hit = np.flatnonzero((codes[place] == grams) & (np.arange(len(grams)) + 2 < ends[row]))
    row, place = row[hit], place[hit]
    for column in range(logs.shape[1]):
        totals[:, column] = np.bincount(row, weights=logs[place, column], minlength=n)
    return np.bincount(row, minlength=n), totals


def _profile_sums(profile: Profile) -> Callable[[Column], Column]:
    """A function giving the sum of log-probabilities per language, NULL without a known trigram.

    Texts are looked up in numpy, many at once, against the bounded profile: as rows,
    every character of the corpus would pass through a join and an aggregation.
    """
    known = profile.rows.orderBy("gram").toPandas()
    codes = np.concatenate([_gram_codes(gram) for gram in known["gram"]] or [np.empty(0, np.uint64)])
    order = np.argsort(codes)
    codes = codes[order]
    logs = known[[_weight(code) for code in profile.languages]].to_numpy(np.int64)[order]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sums(texts: pd.Series) -> pd.Series:
        found: list[np.ndarray | None] = []
        for part in _parts(texts.fillna("").to_list()):
            n_hits, totals = _part_sums(part, codes, logs)
            found += [total if n else None for n, total in zip(n_hits, totals)]
        return pd.Series(found, dtype=object)

    return sums


def detect_language(df: DataFrame, key: str, text: str, profile: Profile, keep: Sequence[str] = ()) -> DataFrame:
    """``(key, keep…, detected)`` for every row.

    A text with characters of an Indic script gets that script's language. Any
    other text gets the language with the largest sum of trigram
    log-probabilities, the first in alphabetical order among equals, or
    ``unknown`` when no trigram is known. Rows are judged where they are read:
    nothing is shuffled but a small input that is dealt out first.
    """
    judged = spread_small_input(df.select(key, *keep, text)).select(
        key,
        *keep,
        script_language(F.col(text)).alias("script"),
        _profile_sums(profile)(F.lower(text)).alias("sums"),
    )

    def best(codes: Sequence[str]) -> Column:
        scored = [
            F.struct(
                F.get("sums", F.lit(profile.languages.index(code))).alias("score"),
                F.lit(-place).alias("place"),
                F.lit(code).alias("code"),
            )
            for place, code in enumerate(codes)
        ]
        return F.when(F.col("sums").isNotNull(), F.array_max(F.array(*scored))["code"])

    by_script = F.col("script")
    shared = [code for code in profile.languages if code in ("hi", "mr")]
    if len(shared) == 2:
        by_script = F.when(by_script == "hi", F.coalesce(best(shared), by_script)).otherwise(by_script)
    detected = F.coalesce(by_script, best(profile.languages), F.lit(UNKNOWN))
    return judged.select(key, *keep, detected.alias("detected"))


def language_score(detected: Column, expected: Column) -> Column:
    """1.0 on a match, else 0.0. The empty code expected of English never matches."""
    return F.when(detected == expected, F.lit(1.0)).otherwise(F.lit(0.0))


def composite_score(score: Column) -> Column:
    return F.round(score * 100).cast("int")


def score_languages(detected: DataFrame, expected: Column) -> DataFrame:
    """Add ``expected``, ``score``, ``composite`` and its twin ``language_detection``."""
    scored = detected.withColumn("expected", expected).withColumn(
        "score", language_score(F.col("detected"), F.col("expected"))
    )
    return scored.withColumns(
        {"composite": composite_score(F.col("score")), "language_detection": composite_score(F.col("score"))}
    )


def score_by_language_name(detected: DataFrame, name: str) -> DataFrame:
    return score_languages(detected, iso_code(F.col(name)))


def language_report(scores: DataFrame) -> DataFrame:
    """``(expected, texts, matched, unknown, mean_composite)`` per expected language."""
    return scores.groupBy("expected").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("score") == 1.0).alias("matched"),
        F.count_if(F.col("detected") == UNKNOWN).alias("unknown"),
        (F.avg("score") * 100).alias("mean_composite"),
    )


def confusion(scores: DataFrame) -> DataFrame:
    """``(expected, detected, texts)``: how often each language was taken for another."""
    return scores.groupBy("expected", "detected").agg(F.count(F.lit(1)).alias("texts"))
