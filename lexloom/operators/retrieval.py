"""Exact cosine retrieval over embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexloom.operators.blocks import DenseKernel, Limits, Matches, Side, search
from lexloom.session import shared_dir

BROADCAST_MATCHES = 500_000
BROADCAST_BYTES = 64 << 20


def dense_side(df: DataFrame, key: str, vector: str) -> Side:
    rows = df.select(F.col(key), F.col(vector).cast("array<float>").alias("vector")).where(
        F.col("vector").isNotNull()
    )

    def bytes_for(n_rows: int) -> int:
        # One vector tells the size of all: vectors of another length fail the search.
        first = rows.select(F.size("vector")).first()
        return n_rows * (4 * first[0] + 64) if first else 0

    return Side(rows, key, df, bytes_for)


def topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    key: str = "key",
    vector: str = "embedding",
    decimals: int = 9,
    strategy: str = "auto",
    limits: Limits = Limits(),
) -> Matches:
    """The ``k`` corpus rows with the largest inner product for every query.

    On unit vectors that is the cosine. There is no score threshold; a corpus
    of fewer than ``k`` rows is returned whole. Rows without a vector never
    match.
    """
    return search(
        dense_side(queries, query_id, vector),
        dense_side(corpus, key, vector),
        k,
        DenseKernel(),
        decimals,
        strategy,
        limits,
    )


def topk_others(queries: DataFrame, corpus: DataFrame, k: int = 5, **options) -> Matches:
    """As :func:`topk`, leaving out the row whose key is the query's own."""
    found = topk(queries, corpus, k + 1, **options)
    order = Window.partitionBy("query_id").orderBy("found_rank")
    others = found.rows.where(F.col("query_id") != F.col("key")).withColumnRenamed("rank", "found_rank")
    ranked = others.withColumn("rank", F.row_number().over(order))
    rows = ranked.where(F.col("rank") <= k).select("query_id", "rank", "key", "similarity")
    return Matches(rows, found.at_most)


def attach_records(matches: Matches, records: DataFrame, key: str) -> DataFrame:
    """Each match with the record it points to; NULL columns where there is no such record.

    The join comes after the search, so it sees at most k rows per query. When
    their number and their keys, measured while they are written, are small, the matches are broadcast
    and the record table is scanned in place; the hits then join the matches, which
    keeps those without a record. Otherwise both sides are shuffled on the key, and a
    record that very many queries point to is split by the adaptive skew join,
    which can divide the match side since record keys are unique.
    """
    named = records.withColumnRenamed(key, "key")
    if matches.at_most > BROADCAST_MATCHES:
        return matches.rows.join(named, "key", "left")
    path, seen = shared_dir(records.sparkSession, "matches"), Observation()
    ids = F.octet_length(F.col("key").cast("string")) + F.octet_length(F.col("query_id").cast("string"))
    measured = matches.rows.observe(seen, F.coalesce(F.sum(ids.cast("long") + 32), F.lit(0)).alias("bytes"))
    measured.write.parquet(path)
    found = records.sparkSession.read.schema(matches.rows.schema).parquet(path)
    if (seen.get.get("bytes") or 0) > BROADCAST_BYTES:
        return found.join(named, "key", "left")
    hits = named.join(F.broadcast(found.select("key")), "key", "left_semi")
    return found.join(hits, "key", "left")


def topk_per_request(
    queries: DataFrame, corpus: DataFrame, k: str, query_id: str = "query_id", **options
) -> Matches:
    """As :func:`topk` with the number of matches in column ``k`` of each query.

    The search takes the largest number and each query keeps its own. A query whose number is
    NULL or below 1 has no match.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(k).alias("asked")).where("asked >= 1")
    most = asked.agg(F.max("asked")).first()[0] or 1
    found = topk(queries, corpus, most, query_id=query_id, **options)
    own = found.rows.join(asked, "query_id").where("rank <= asked").drop("asked")
    return Matches(own, found.at_most)


def hit_rate(matches: Matches, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``(label, queries, hits, hit_rate)``: how often a query's matches hold its own label.

    ``labels`` gives the label of queries and corpus rows alike. Queries without
    any match count as misses.
    """
    labelled = labels.select(key, F.col(label).alias("label"))
    found = (
        attach_records(matches, labelled, key)
        .groupBy("query_id")
        .agg(F.collect_set("label").alias("found"))
    )
    judged = labelled.join(found, labelled[key] == found["query_id"], "left").select(
        "label", F.coalesce(F.array_contains("found", F.col("label")), F.lit(False)).alias("hit")
    )
    return judged.groupBy("label").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("hit").alias("hits"),
        F.avg(F.col("hit").cast("int")).alias("hit_rate"),
    )
