"""From requests to results in three jobs with tables between them.

The services themselves are called elsewhere: each job reads the responses to
the requests that the job before it wrote.

1. :func:`inputs_to_translate` — requests to translation requests into English;
2. :func:`english_inputs` and :func:`guidance` — translations to chat requests;
3. :func:`answers`, :func:`answers_to_translate`, :func:`final_answers` — chat responses to
   results in the user's language, then :func:`answers_to_speak` and :func:`score_answers`.

Write each job's tables before the next one reads them: sizes are measured where
a side may be broadcast, and that should not run a whole job twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.languages import ENGLISH_LOCALE
from lexloom.functions.responses import chat_content, transcript, translated_text
from lexloom.operators.chunking import join_chunks
from lexloom.operators.context import explanation_requests, guidance_requests, retrieval_context
from lexloom.operators.language import Profile, detect_language, score_by_language_name
from lexloom.operators.ledger import ANSWERED, DEAD, OUTSTANDING, call_states, dead_letters, keyed, responded, to_send
from lexloom.operators.requests import (
    SPEECH_CHUNKS,
    accepted,
    plan_languages,
    resolve_requests,
    speech_requests,
    translation_requests,
)
from lexloom.operators.retrieval import attach_records, topk
from lexloom.session import written


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Resolved, non-blank requests with their locale and gate.

    ``requests`` holds ``request_id, language, has_key, typed, transcript``.
    """
    return plan_languages(accepted(resolve_requests(requests, "typed", "transcript")), "language", "has_key")


def attach_transcripts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Add ``transcript`` from ``(request_id, response)``; empty where speech failed or none was sent."""
    spoken = responses.select("request_id", transcript(F.col("response")).alias("transcript"))
    return requests.join(spoken, "request_id", "left").fillna({"transcript": ""})


def inputs_to_translate(prepared: DataFrame) -> DataFrame:
    """``(request_id, chunk_no, payload)`` for requests in another language than English."""
    return translation_requests(
        prepared, "request_id", "resolved", F.col("locale"), F.lit(ENGLISH_LOCALE), F.col("multilingual")
    )


def apply_translations(
    texts: DataFrame, key: str, text: str, sent: DataFrame, responses: DataFrame
) -> DataFrame:
    """``texts`` with ``translated``: the answered chunks rejoined, or the text where none were sent.

    ``n_untranslated`` counts the chunks sent that came back without a translation. ``responses`` holds ``(key, chunk_no, response)``. A chunk whose response is
    missing or carries no translation keeps its source text.
    """
    own = F.lit(None).cast("string")
    answered = sent.join(responses, [key, "chunk_no"], "left").select(
        key,
        "chunk_no",
        translated_text(F.col("response"), F.col("payload.input")).alias("chunk"),
        translated_text(F.col("response"), own).isNull().alias("kept"),
    )
    joined = join_chunks(answered, key).withColumnRenamed("text", "rejoined")
    kept = answered.groupBy(key).agg(F.count_if("kept").alias("n_untranslated"))
    merged = texts.join(joined, key, "left").join(kept, key, "left")
    return merged.withColumns(
        {"translated": F.coalesce("rejoined", text), "n_untranslated": F.coalesce("n_untranslated", F.lit(0))}
    ).drop("rejoined")


@dataclass(frozen=True)
class Translated:
    """Texts with what came back so far, the calls to make now, and the chunks whose call was given up."""

    texts: DataFrame
    to_send: DataFrame
    given_up: DataFrame


def apply_translation_calls(
    texts: DataFrame, key: str, text: str, sent: DataFrame, responses: DataFrame, max_attempts: int = 3
) -> Translated:
    """As :func:`apply_translations`, from calls that may fail, come late or come back more than once.

    ``responses`` holds ``request_key, status, attempt, received, response`` (see :mod:`lexloom.operators.ledger`); chunks with equal payloads
    are one call. Each text gets a ``status``: ``done``, ``waiting`` while calls of it are to be made, or ``failed`` if one was given up. A chunk
    without a translation keeps its source text. The states are written once, as the three tables are made of them.
    """
    asked = keyed(sent)
    own = F.lit(None).cast("string")
    states = written(call_states(asked, responses, translated_text(F.col("response"), own).isNotNull(), max_attempts), "call-states")
    chunks = responded(asked, states)
    merged = apply_translations(texts, key, text, sent, chunks.where(F.col("state") == ANSWERED).select(key, "chunk_no", "response"))
    worst = F.when(F.max(F.col("state") == DEAD), "failed").when(F.max(F.col("state") == OUTSTANDING), "waiting").otherwise("done")
    status = chunks.groupBy(key).agg(worst.alias("status"))
    done = merged.join(status, key, "left").fillna({"status": "done"})
    return Translated(done, to_send(asked, states), dead_letters(asked, states))


def english_inputs(prepared: DataFrame, sent: DataFrame, responses: DataFrame) -> DataFrame:
    return apply_translations(prepared, "request_id", "resolved", sent, responses)


def guidance(
    inputs: DataFrame,
    corpus: DataFrame,
    key: str,
    name: str,
    text: str,
    k: int = 5,
    query_id: str = "request_id",
    query_text: str = "translated",
    vector: str = "embedding",
    query_vectors: DataFrame | None = None,
    records: DataFrame | None = None,
    **options,
) -> DataFrame:
    """``(query_id, messages, max_tokens)`` with the k nearest sections as context.

    By default ``inputs`` carry their query vectors and ``corpus``, an embedding
    table, its records. Where vectors are tables of their own, pass
    ``query_vectors`` and ``records``: the search then reads vectors only, and
    texts are joined once the matches are known.
    """
    query_vectors = inputs if query_vectors is None else query_vectors
    records = corpus if records is None else records
    found = topk(query_vectors, corpus, k, query_id, key, vector, **options)
    matched = attach_records(found, records.select(key, name, text), key)
    return guidance_requests(inputs, retrieval_context(matched, "key", name, text), query_id, query_text)


def explanations(inputs: DataFrame, query_id: str = "request_id", text: str = "resolved") -> DataFrame:
    return explanation_requests(inputs, query_id, text)


def answers(prepared: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with its English ``answer`` and its ``status``.

    ``responses`` holds ``(request_id, response)``. The status is ``answered``, ``empty`` for a response
    without content, or ``missing``; the last two have a NULL answer and stay in the table.
    """
    content = responses.select(
        "request_id", chat_content(F.col("response")).alias("answer"), F.lit(True).alias("responded")
    )
    status = F.when(F.col("responded").isNull(), "missing").when(F.col("answer").isNull(), "empty")
    joined = prepared.join(content, "request_id", "left")
    return joined.withColumn("status", status.otherwise("answered")).drop("responded")


def answers_to_translate(answered: DataFrame) -> DataFrame:
    return translation_requests(
        answered, "request_id", "answer", F.lit(ENGLISH_LOCALE), F.col("locale"), F.col("multilingual")
    )


def final_answers(answered: DataFrame, sent: DataFrame, responses: DataFrame) -> DataFrame:
    return apply_translations(answered, "request_id", "answer", sent, responses)


def answers_to_speak(final: DataFrame, max_chunks: int = SPEECH_CHUNKS) -> DataFrame:
    """``(request_id, payload, n_dropped)`` for the answers that were translated."""
    return speech_requests(
        final.where("multilingual"), "request_id", "translated", F.col("locale"), max_chunks
    )


def score_answers(final: DataFrame, profile: Profile) -> DataFrame:
    """Language scores of the answers that were translated."""
    judged = detect_language(
        final.where("multilingual"), "request_id", "translated", profile, keep=("language",)
    )
    return score_by_language_name(judged, "language")
