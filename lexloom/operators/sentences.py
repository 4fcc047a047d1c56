"""Where sentences end: signs of several scripts, and abbreviations learned from how words stand before full stops."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import spread_small_input



@dataclass(frozen=True)
class Evidence:
    """A word counts as an abbreviation if it stands with a full stop ``least`` times or more, in ``with_stop`` of its
    places, and is followed by a small letter or a digit in ``goes_on`` of these; and if it has at most ``longest`` letters. The ``top_n`` most
    frequent are kept, so that the pattern made of them has a bounded size."""

    least: int = 5
    with_stop: float = 0.8
    goes_on: float = 0.3
    longest: int = 6
    top_n: int = 300


#: A token that is a word: opening signs, the word, whether a full stop follows, closing signs.
WORD = r"^[\"'“(\[]*([\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*)(\.?)[\"'”)\],;:!?]*$"


def abbreviation_counts(documents: DataFrame, text: str, longest: int = 6) -> DataFrame:
    """``(word, places, stops, going_on)`` of the words of up to ``longest`` characters; counts of several batches add up.

    ``stops`` counts the places before a full stop, ``going_on`` those of them where a small letter or a digit comes next. Texts are taken apart
    in the task that reads them; one row a word and task is shuffled.
    """
    tokens = F.split(F.regexp_replace(F.col(text), r"\s+", " "), " ")
    rows = spread_small_input(documents.select(text)).select(tokens.alias("tokens"))
    following = F.concat(F.slice("tokens", 2, F.size("tokens")), F.array(F.lit("")))
    pairs = F.zip_with("tokens", following, lambda t, n: F.struct(t.alias("token"), n.alias("next")))
    each = rows.where(F.col("tokens").isNotNull()).select(F.inline(pairs))
    parts = each.select(
        F.lower(F.regexp_extract("token", WORD, 1)).alias("word"),
        (F.regexp_extract("token", WORD, 2) == ".").alias("stop"),
        F.rlike("next", F.lit(r"^[\p{Ll}\p{Nd}]")).alias("on"),
    )
    return parts.where((F.col("word") != "") & (F.length("word") <= longest)).groupBy("word").agg(
        F.count(F.lit(1)).alias("places"), F.count_if("stop").alias("stops"), F.count_if(F.col("stop") & F.col("on")).alias("going_on")
    )


def abbreviations(counts: DataFrame, evidence: Evidence = Evidence()) -> DataFrame:
    """``(word, places, stops, going_on)`` of the words that the counts show to be abbreviations, most frequent first."""
    merged = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("places", "stops", "going_on")])
    shown = merged.where(
        (F.col("stops") >= evidence.least)
        & (F.col("stops") >= evidence.with_stop * F.col("places"))
        & (F.col("going_on") >= evidence.goes_on * F.col("stops"))
        & (F.length("word") <= evidence.longest)
    )
    return shown.orderBy(F.col("stops").desc(), "word").limit(evidence.top_n)


def end_pattern(known: Iterable[str] = ()) -> str:
    """Pattern of the space between two sentences, for :func:`lexloom.functions.text.paragraph_chunks`.

    A sentence ends after a full stop, question or exclamation mark and closing quotes or brackets, where space and no small
    letter follow; but not after a single letter or one of the ``known`` abbreviations and its full stop. It also
    ends after a danda or double danda, with or without space.
    """
    words = "|".join(re.escape(word) for word in sorted(known, key=lambda w: (-len(w), w)))
    after_word = rf"(?<!(?i:\b(?:{words}))\.)" if words else ""
    return rf"(?<=[.!?…][\"'”’)\]]{{0,2}})(?<!\b\p{{L}}\.){after_word}\s+(?!\p{{Ll}})|(?<=[\u0964\u0965])\s*"


def sentences(text: Column, ends: str) -> Column:
    """The sentences of a text, in order, without the space between them."""
    return F.filter(F.split(F.trim(text), ends), lambda s: s != "")
