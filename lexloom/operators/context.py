"""Retrieval context and chat requests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.hints import hint_block_column
from lexloom.functions.text import preview, similarity_label

PROMPT_PREVIEW = 300
DISPLAY_PREVIEW = 400
ORIGINAL_PREVIEW = 120

EXPLAIN_TOKENS = 1024
GUIDANCE_TOKENS = 1200

EXPLAIN_ROLE = "Input: a passage of law. Output: a plain English paragraph that a school pupil understands."
GUIDANCE_ROLE = (
    "Input: an incident, sections of law found for it, and a list of offenses. "
    "Output, in plain English and under three headings: applicable sections with a reason each; "
    "facts a police report still lacks; next steps."
)


def match_display(matches: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """``(query_id, rank, section, name, cosine, excerpt)`` for showing matches to a person."""
    return matches.select(
        "query_id",
        "rank",
        F.col(key).cast("string").alias("section"),
        F.col(name).alias("name"),
        similarity_label(F.col("similarity")).alias("cosine"),
        preview(F.col(text), DISPLAY_PREVIEW).alias("excerpt"),
    )


def section_line(key: Column, name: Column, text: Column) -> Column:
    return F.concat(
        F.lit("- Section "),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(" ("),
        F.coalesce(name, F.lit("")),
        F.lit("): "),
        preview(text, PROMPT_PREVIEW),
    )


def retrieval_context(matches: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """``(query_id, n_sections, context)``: one line per match, in rank order.

    Texts are cut to their preview before the shuffle, and a group has at most
    k lines.
    """
    line = section_line(F.col(key), F.col(name), F.col(text)).alias("line")
    lines = F.sort_array(F.collect_list(F.struct("rank", "line")))
    return (
        matches.select("query_id", "rank", line)
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n_sections"),
            F.array_join(F.transform(lines, lambda part: part["line"]), "\n").alias("context"),
        )
    )


def messages(system: Column, user: Column) -> Column:
    """The ordered two-message conversation of one request."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", system), message("user", user))


def guidance_requests(
    requests: DataFrame,
    context: DataFrame,
    query_id: str,
    text: str,
    role: str = GUIDANCE_ROLE,
    max_tokens: int = GUIDANCE_TOKENS,
) -> DataFrame:
    """``(query_id, messages, max_tokens)``: incident, retrieved sections, offense reference.

    A request for which nothing was retrieved is still sent, with an empty list.
    """
    block = hint_block_column(requests.sparkSession)
    incidents = requests.select(F.col(query_id).alias("query_id"), F.col(text).alias("incident"))
    user = F.concat(
        F.lit("Incident: "),
        F.coalesce("incident", F.lit("")),
        F.lit("\n\nSections found:\n"),
        F.coalesce("context", F.lit("")),
        F.lit("\n\nOffense reference:\n"),
        block,
    )
    return incidents.join(context, "query_id", "left").select(
        "query_id",
        messages(F.lit(role), user).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
    )


def explanation_requests(
    requests: DataFrame,
    query_id: str,
    text: str,
    role: str = EXPLAIN_ROLE,
    max_tokens: int = EXPLAIN_TOKENS,
) -> DataFrame:
    """``(query_id, messages, max_tokens)`` for explaining a text, without retrieval."""
    user = F.concat(F.lit("Explain in simple words:\n\n"), F.coalesce(text, F.lit("")))
    return requests.select(
        F.col(query_id).alias("query_id"),
        messages(F.lit(role), user).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
    )


def message_rows(requests: DataFrame) -> DataFrame:
    """``(query_id, pos, role, content, max_tokens)``, one row per message."""
    return requests.select(
        "query_id", "max_tokens", F.posexplode_outer("messages").alias("pos", "message")
    ).select("query_id", "pos", "message.role", "message.content", "max_tokens")
