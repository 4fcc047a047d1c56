"""Text queries to matched records in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lexloom.operators.embed import Encoder, embed_texts
from lexloom.operators.retrieval import attach_records, topk


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    load_model: Callable[[], Encoder],
    k: int = 5,
    query_id: str = "query_id",
    text: str = "text",
    key: str = "key",
    records: DataFrame | None = None,
    batch_size: int = 64,
    **options,
) -> DataFrame:
    """``(query_id, rank, similarity, key, …)``: the k nearest records of every query text.

    ``corpus`` is an embedding table built with the same model. Its payload is
    attached after the search, or that of ``records`` where given.
    """
    embedded = embed_texts(queries.select(query_id, text), text, load_model, batch_size)
    found = topk(embedded, corpus, k, query_id, key, **options)
    payload = corpus.drop("embedding") if records is None else records
    return attach_records(found, payload, key)
