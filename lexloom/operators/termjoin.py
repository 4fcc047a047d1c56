"""Sparse retrieval as joins on terms: no row of one side ever meets all rows of the other.

Queries and documents are tables of (key, term, weight). A first round joins each query on its rarest terms and scores the best
documents found so, exactly; the kth of these scores is a floor that the final kth score cannot fall below. The second round joins only on
the terms without which no document can reach that floor: with a query's terms in order of the most they can add to
a score, that is the shortest prefix whose remaining terms together stay below the floor. Every document that can
be among the k best shares a term of the prefix; the others are never paired with the query. Frequent terms are split
by salt, so that none of them gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import sparse
from lexloom.operators.blocks import Matches
from lexloom.session import written


@dataclass(frozen=True)
class JoinSettings:
    """``seeds`` times k documents are looked at to find the floor. A term of more than ``rows_per_salt`` documents is split into parts of
    that size; the ``salted_terms`` most frequent are told to every task (a digest of 32 bytes each at most). Documents' entries are cut down to the terms
    asked for before they are shuffled, if those terms take up to ``term_bytes``."""

    seeds: int = 4
    rows_per_salt: int = 200_000
    salted_terms: int = 10_000
    term_bytes: int = 32 << 20


def short_name(term: Column) -> Column:
    """The term itself, or a digest in place of a long one, so that a set of terms has a bounded size."""
    return F.when(F.octet_length(term) > 64, F.sha2(term, 256)).otherwise(term)


def _entries(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(
        key, F.col("e.terms").alias("term"), F.col("e.weights").alias("weight")
    )


def _partial_scores(asked: DataFrame, entries: DataFrame, s: JoinSettings) -> DataFrame:
    """``(query_id, key, got)``: what the asked terms add to the score of every document that holds one of them."""
    terms = asked.select("term", "df").distinct()
    size = terms.agg(F.coalesce(F.sum(F.least(F.octet_length("term"), F.lit(64)).cast("long") + 32), F.lit(0))).first()[0]
    if size <= s.term_bytes:
        wanted = terms.select(short_name(F.col("term")).alias("name"))
        entries = entries.join(F.broadcast(wanted), short_name(F.col("term")) == F.col("name"), "left_semi")
    salts = F.ceil(F.col("df") / s.rows_per_salt).cast("int")
    hot = terms.where(F.col("df") > s.rows_per_salt).orderBy(F.col("df").desc(), "term").limit(s.salted_terms)
    hot = hot.select(short_name(F.col("term")).alias("name"), salts.alias("salts"))

    def salted(side: DataFrame, salt: Column) -> DataFrame:
        known = side.join(F.broadcast(hot), short_name(F.col("term")) == F.col("name"), "left")
        return known.withColumn("salt", salt).drop("name", "salts")

    many = F.coalesce("salts", F.lit(1))
    left = salted(asked, F.explode(F.sequence(F.lit(0), many - 1)))
    right = salted(entries, F.pmod(F.xxhash64("key"), many).cast("int"))
    met = left.select("query_id", "term", "salt", F.col("weight").alias("asked")).join(right, ["term", "salt"])
    return met.groupBy("query_id", "key").agg(F.sum(F.col("asked") * F.col("weight")).alias("got"))


def _exact_scores(pairs: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """``(query_id, key, dot)`` of the given pairs.

    A pair's document is taken apart into its terms, which are looked up in the query's, so that a pair costs the terms of one side and not the
    product of both. Rows of a repeated key (``row``, ``asked_row``) are scored one by one.
    """
    entries = pairs.select("query_id", "key").join(documents.select("key", "row", "terms", "weights"), "key")
    entries = entries.select("query_id", "key", "row", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    entries = entries.select("query_id", "key", "row", F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))
    asked = queries.select("query_id", "asked_row", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    asked = asked.select("query_id", "asked_row", F.col("e.terms").alias("term"), F.col("e.weights").alias("asked"))
    met = entries.join(asked, ["query_id", "term"])
    dots = met.groupBy("query_id", "key", "row", "asked_row").agg(F.sum(F.col("asked") * F.col("weight")).alias("dot"))
    return dots.select("query_id", "key", "dot")


def _best(scored: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col(by).desc(), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_by_term_join(
    queries: DataFrame,
    documents: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    query_text: str = "text",
    key: str = "key",
    text: str = "text",
    decimals: int = 4,
    separators: str = sparse.SEPARATORS,
    vocabulary: sparse.Vocabulary | None = None,
    vocabulary_bytes: int = sparse.BROADCAST_BYTES,
    settings: JoinSettings = JoinSettings(),
) -> Matches:
    """The result of :func:`lexloom.operators.sparse.topk_by_terms`, by shuffle joins on terms.

    Use it where neither side is small: what is paired grows with the documents that share a telling term with a query, not with the product of the
    sides. Keys must be unique on either side; rows without one never match.
    """
    spark = documents.sparkSession
    own = vocabulary is None
    vocabulary = vocabulary or sparse.build_vocabulary(documents, text, separators)

    def vectors(df: DataFrame, name: str, body: str, new_name: str, **options) -> DataFrame:
        rows = df.select(F.col(name).alias(new_name), F.col(body).alias("body")).where(F.col(new_name).isNotNull())
        return sparse.term_vectors(rows, new_name, "body", vocabulary, separators, vocabulary_bytes, **options)

    asked_vectors = vectors(queries, query_id, query_text, "query_id")
    asked_vectors = written(asked_vectors.withColumn("asked_row", F.monotonically_increasing_id()), "query-vectors")
    terms = sparse.Asked.by(asked_vectors) if own else None
    held = vectors(documents, key, text, "key", asked=terms, counted_from=own).withColumn("row", F.monotonically_increasing_id())
    held = written(held, "document-vectors")
    entries = _entries(held, "key")

    reach = entries.groupBy("term").agg(F.count("*").alias("df"), F.max("weight").alias("most"))
    asked = _entries(asked_vectors, "query_id").join(reach, "term")
    asked = written(asked.withColumn("reach", F.col("weight") * F.col("most")), "asked-terms")

    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("df").over(rarest), F.lit(0))
    seeds = asked.withColumn("before", before).where(F.col("before") < settings.seeds * k)
    seeds = _best(_partial_scores(seeds, entries, settings), "got", settings.seeds * k)
    seeds = _exact_scores(seeds, asked_vectors, held)
    # Scores are rounded before they are ranked: whatever may round up to the kth score counts.
    floor = _best(seeds, "dot", k).where(F.col("rank") == k)
    floor = floor.select("query_id", (F.round("dot", decimals) - 0.5 * 10.0**-decimals - 1e-9).alias("floor"))

    strongest = Window.partitionBy("query_id").orderBy(F.col("reach").desc(), "term")
    from_here = F.sum("reach").over(strongest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = asked.join(floor, "query_id", "left").withColumn("left", from_here)
    ranked = ranked.withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    ranked = written(ranked.withColumn("needed", F.col("left") >= F.col("floor")), "ranked-terms")
    rest = ranked.groupBy("query_id", "floor").agg(F.coalesce(F.sum(F.when(~F.col("needed"), F.col("reach"))), F.lit(0.0)).alias("rest"))
    pairs = _partial_scores(ranked.where("needed"), entries, settings).join(rest, "query_id")
    able = pairs.where(F.col("got") + F.col("rest") + 1e-9 >= F.col("floor"))

    scored = _exact_scores(able, asked_vectors, held).select("query_id", "key", F.round("dot", decimals).alias("similarity"))
    found = _best(scored, "similarity", k).select("query_id", "rank", "key", "similarity")
    return Matches(found, asked_vectors.count() * k)
