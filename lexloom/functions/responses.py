"""Fields of JSON service responses, by declared schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAT_SCHEMA = "struct<choices:array<struct<message:struct<content:string>>>>"


def chat_content(response: Column) -> Column:
    """``choices[0].message.content``; NULL when absent or malformed."""
    choices = F.from_json(response, CHAT_SCHEMA)["choices"]
    return F.get(choices, F.lit(0))["message"]["content"]


def translated_text(response: Column, source_chunk: Column) -> Column:
    """The translation, or the source chunk when the response carries none."""
    return F.coalesce(F.from_json(response, "struct<translated_text:string>")["translated_text"], source_chunk)


def transcript(response: Column) -> Column:
    return F.coalesce(F.from_json(response, "struct<transcript:string>")["transcript"], F.lit(""))


def audios(response: Column) -> Column:
    """Encoded audio parts in order; an empty list when there are none."""
    parts = F.from_json(response, "struct<audios:array<string>>")["audios"]
    return F.coalesce(parts, F.array().cast("array<string>"))
