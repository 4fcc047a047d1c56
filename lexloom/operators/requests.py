"""Input resolution and the request tables of the translation and speech services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.languages import (
    ENGLISH_LOCALE,
    is_multilingual,
    locale_code,
    needs_translation,
)
from lexloom.functions.text import first_chunks, n_dropped, paragraph_chunks, sentence_chunks, strip
from lexloom.operators.chunking import explode_chunks
from lexloom.session import spread_small_input

TRANSLATION_LIMIT = 900
SPEECH_LIMIT = 480
SPEECH_CHUNKS = 3

# Settings the translation service expects per direction.
INTO_ENGLISH = {
    "speaker_gender": "Female",
    "mode": "formal",
    "model": "mayura:v1",
    "enable_preprocessing": True,
}
FROM_ENGLISH = {"model": "sarvam-translate:v1", "enable_preprocessing": False}

# Fixed value: the model of the transcription service.
TRANSCRIPT_MODEL = "saarika:v2.5"

# Settings the speech service expects.
SPEECH = {
    "speaker": "anushka",
    "pitch": 0,
    "pace": 1.0,
    "loudness": 1.5,
    "speech_sample_rate": 8000,
    "enable_preprocessing": True,
    "model": "bulbul:v2",
}


def resolve_input(typed: Column, transcript: Column, trim_typed: bool = True) -> Column:
    """A non-empty transcript wins over the typed text."""
    text = strip(typed) if trim_typed else typed
    return F.coalesce(F.nullif(transcript, F.lit("")), text, F.lit(""))


def resolve_requests(
    requests: DataFrame, typed: str, transcript: str, trim_typed: bool = True, reject_blank: bool = True
) -> DataFrame:
    """Add ``resolved`` and ``accepted``; nothing is dropped."""
    resolved = requests.withColumn("resolved", resolve_input(F.col(typed), F.col(transcript), trim_typed))
    return resolved.withColumn("accepted", (F.col("resolved") != "") if reject_blank else F.lit(True))


def plan_languages(requests: DataFrame, language: str, has_key: str | None = None) -> DataFrame:
    """Add ``locale``, ``supported`` and ``multilingual`` to requests that name their language.

    A language that is missing or not in the table is not supported: it has no locale, and nothing
    is translated for it. Such requests stay here; :func:`unsupported` finds them.
    """
    key = F.col(has_key) if has_key else None
    locale = locale_code(F.col(language))
    multilingual = locale.isNotNull() & F.coalesce(is_multilingual(F.col(language), key), F.lit(False))
    return requests.withColumns({"locale": locale, "supported": locale.isNotNull(), "multilingual": multilingual})


def transcript_requests(requests: DataFrame, key: str, sound: str, locale: Column) -> DataFrame:
    """``(key, payload)`` for every request that carries sound; the bytes stay in the request table."""
    is_wave = F.substring(F.col(sound), 1, 4) == F.lit(b"RIFF")
    kind = F.when(is_wave, F.lit("wav")).otherwise(F.lit("webm"))
    payload = F.struct(
        F.concat(F.lit("audio."), kind).alias("file_name"),
        F.concat(F.lit("audio/"), kind).alias("media_type"),
        locale.alias("language_code"),
        F.lit(TRANSCRIPT_MODEL).alias("model"),
    )
    return requests.where(F.octet_length(sound) > 0).select(key, payload.alias("payload"))


def _settings(values: dict, names: list[str]) -> list[Column]:
    return [F.lit(values.get(name)).alias(name) for name in names]


def translation_payload(chunk: Column, source: Column, target: Column) -> Column:
    """The request body as a struct; settings that a direction does not send are NULL.

    ``to_json`` leaves NULL fields out.
    """
    names = list(INTO_ENGLISH)
    types = {"enable_preprocessing": "boolean"}

    def body(values: dict) -> Column:
        settings = [c.cast(types.get(n, "string")).alias(n) for n, c in zip(names, _settings(values, names))]
        return F.struct(
            chunk.alias("input"),
            source.alias("source_language_code"),
            target.alias("target_language_code"),
            *settings,
        )

    return F.when(target == ENGLISH_LOCALE, body(INTO_ENGLISH)).otherwise(body(FROM_ENGLISH))


def translation_requests(
    texts: DataFrame,
    key: str,
    text: str,
    source: Column,
    target: Column,
    has_key: Column | None = None,
    limit: int = TRANSLATION_LIMIT,
) -> DataFrame:
    """``(key, chunk_no, payload)``: one row per chunk to translate.

    Texts that pass through unchanged have no rows here; they are never chunked.
    """
    wanted = needs_translation(F.col(text), source, target, has_key)
    routed = texts.where(wanted).select(key, text, source.alias("source"), target.alias("target"))
    chunks = explode_chunks(
        spread_small_input(routed), paragraph_chunks(F.col(text), limit), key, "source", "target"
    )
    return chunks.select(
        key, "chunk_no", translation_payload(F.col("chunk"), F.col("source"), F.col("target")).alias("payload")
    )


def speech_requests(
    texts: DataFrame,
    key: str,
    text: str,
    locale: Column,
    max_chunks: int = SPEECH_CHUNKS,
    limit: int = SPEECH_LIMIT,
) -> DataFrame:
    """``(key, payload, n_dropped)``: the first chunks of each text and how many were left out.

    Texts without a sentence have no request.
    """
    spoken = spread_small_input(texts.select(key, locale.alias("locale"), text))
    chunked = spoken.select(key, "locale", sentence_chunks(F.col(text), limit).alias("chunks"))
    settings = [F.lit(value).alias(name) for name, value in SPEECH.items()]
    payload = F.struct(
        first_chunks(F.col("chunks"), max_chunks).alias("inputs"),
        F.col("locale").alias("target_language_code"),
        *settings,
    )
    return chunked.where(F.size("chunks") > 0).select(
        key, payload.alias("payload"), n_dropped(F.col("chunks"), max_chunks).alias("n_dropped")
    )


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where("accepted")


def unsupported(planned: DataFrame) -> DataFrame:
    """Requests of :func:`plan_languages` in a language that no service handles."""
    return planned.where(~F.col("supported"))


def rejected(requests: DataFrame) -> DataFrame:
    return requests.where(~F.col("accepted"))


