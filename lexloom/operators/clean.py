"""Header and row cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import flatten_line_breaks


def normalise_name(name: str) -> str:
    """Whitespace and underscore runs become one underscore, none at the ends."""
    return re.sub(r"[\s_]+", "_", name).strip("_")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Rename by position. Names that would collide raise instead of becoming ambiguous."""
    names = [normalise_name(name) for name in df.columns]
    twice = sorted({name for name in names if names.count(name) > 1})
    if twice:
        raise ValueError(f"headers collide after normalising: {', '.join(twice)}")
    return df.toDF(*names)


def clean_text_rows(
    df: DataFrame,
    text: str,
    longer_than: int,
    trim: Sequence[str] = (),
    flatten: bool = False,
    header_column: str | None = None,
) -> DataFrame:
    """Trim columns and drop rows whose text is too short.

    Trimming removes plain spaces only. ``flatten`` turns line breaks of the
    text column into spaces first. The length test is strict, counts
    characters and drops NULL. With ``header_column``, rows that repeat the
    header (value equal to the column's own name) go too, and so do rows where
    it is NULL. Other columns pass through.
    """
    body = flatten_line_breaks(F.col(text)) if flatten else F.col(text)
    trimmed = {name: F.trim(F.col(name)) for name in trim}
    out = df.withColumns({**trimmed, text: F.trim(body)}).where(F.length(text) > longer_than)
    return out.where(F.col(header_column) != F.lit(header_column)) if header_column else out


def clean_sections(df: DataFrame) -> DataFrame:
    """The law-section table: six text columns, descriptions longer than 20 characters."""
    return clean_text_rows(
        df,
        text="Description",
        longer_than=20,
        trim=("Chapter", "Chapter_name", "Chapter_subtype", "Section", "Section_name"),
        flatten=True,
        header_column="Section",
    )


def clean_incidents(df: DataFrame) -> DataFrame:
    """The labelled incident table: descriptions longer than 5 characters."""
    return clean_text_rows(df, text="incident_description", longer_than=5, trim=("offense_type",))
