"""Chunk tables and their reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """``(keep…, chunk_no, chunk)``, one row per chunk; rows without chunks vanish.

    Chunks are cut where their text is read. The outer form is used because the plain one would add a filter on the
    chunk list and so cut every text twice.
    """
    rows = df.select(*keep, F.posexplode_outer(chunks).alias("chunk_no", "chunk"))
    return rows.where(F.col("chunk").isNotNull())


def join_chunks(chunks: DataFrame, *keys: str, chunk: str = "chunk", joiner: str = "\n") -> DataFrame:
    """``(keys…, text)``: chunks of one document joined in order.

    A group is as large as one document, which began as a single row.
    """
    ordered = F.sort_array(F.collect_list(F.struct("chunk_no", chunk)))
    return chunks.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda part: part[chunk]), joiner).alias("text")
    )
