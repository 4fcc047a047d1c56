"""TF-IDF vectors held as term and weight arrays, and exact retrieval over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.operators.blocks import Limits, Matches, Side, SparseKernel, search
from lexloom.session import shared_dir, spread_small_input, written

# Letters and the marks that carry vowel signs; everything else separates tokens.
SEPARATORS = r"[^\p{L}\p{M}]+"
BROADCAST_BYTES = 64 << 20
HOT_TERMS = 10_000
#: Bytes of the hashes of the terms that queries hold, up to which documents are cut down to those terms.
ASKED_BYTES = 16 << 20


def tokens(text: Column, separators: str = SEPARATORS) -> Column:
    return F.filter(F.split(F.lower(text), separators), lambda token: token != "")


def term_counts(text: Column, separators: str = SEPARATORS) -> Column:
    """``array<struct<term, tf>>`` of one text, without leaving its row.

    The tokens are sorted and each run of equal ones becomes an entry. The
    sorted array sits in a one-element array so that it is computed once.
    """

    def runs(words: Column) -> Column:
        places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(
            places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, F.greatest(i - 1, F.lit(0))))
        )
        return F.transform(
            F.array(starts),
            lambda begin: F.zip_with(
                begin,
                F.concat(F.slice(begin, 2, F.greatest(F.size(begin), F.lit(1))), F.array(F.size(words))),
                lambda start, end: F.struct(
                    F.get(words, start).alias("term"), (end - start).alias("tf")
                ),
            ),
        )[0]

    listed = F.transform(F.array(F.sort_array(tokens(text, separators))), runs)[0]
    return F.filter(listed, lambda entry: entry["term"].isNotNull())


@dataclass(frozen=True)
class Vocabulary:
    """Terms that tell documents apart: ``(term, df, idf)``, idf above zero.

    ``repeated`` has the 64-bit hash and df of the terms that more than one document holds, those of weight zero too. In the documents
    that were counted every other term has df 1. ``repeated_bytes`` is its size, or None where the hashes of two terms are equal.
    """

    rows: DataFrame
    n_bytes: int
    n_documents: int
    repeated: DataFrame | None = None
    repeated_bytes: int | None = None


def build_vocabulary(documents: DataFrame, text: str, separators: str = SEPARATORS) -> Vocabulary:
    """Document frequencies of all terms, written once to the shared folder.

    Each document counts a term once within its row, so only per-task partial
    counts are shuffled. Every later step reads the written table, whose size is
    then known. A term found in every document has weight zero and is left out.
    """
    spark = documents.sparkSession
    n_documents = documents.count()
    path = shared_dir(spark, "vocabulary")
    (
        spread_small_input(documents.select(text))
        .select(F.explode(F.array_distinct(tokens(F.col(text), separators))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", F.log((F.lit(n_documents) + 1) / (F.col("df") + 1)))
        .write.parquet(path)
    )
    counted = spark.read.parquet(path)
    rows = counted.where(F.col("idf") > 0)
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("term").cast("long") + 32), F.lit(0))).first()[0]
    hashed = counted.select(F.xxhash64("term").alias("hash"), "df")
    repeated = hashed.where(F.col("df") > 1)
    clash = hashed.groupBy("hash").count().where(F.col("count") > 1).limit(1).count()
    return Vocabulary(rows, n_bytes, n_documents, repeated, None if clash else 12 * repeated.count())


def _weigh_in_place(counted: DataFrame, key: str, vocabulary: Vocabulary) -> DataFrame:
    """Weigh whole rows against a broadcast vocabulary; nothing is exploded or shuffled."""
    known = vocabulary.rows.select("term", "idf").toArrow().combine_chunks()
    held = counted.sparkSession.sparkContext.broadcast(
        (known.column("term").combine_chunks(), known.column("idf").to_numpy())
    )
    schema = T.StructType(
        [
            counted.schema[key],
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("weights", T.ArrayType(T.DoubleType())),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = held.value
        for batch in batches:
            counts = batch.column("counts")
            lengths = pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False)
            entries = counts.flatten()
            place = pc.index_in(entries.field("term"), value_set=terms)
            found = place.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)[found]
            tf = entries.field("tf").to_numpy(zero_copy_only=False)[found]
            weight = tf * idf[place.drop_null().to_numpy(zero_copy_only=False)]
            norm = np.sqrt(np.bincount(row, weight * weight, len(lengths)))
            size = np.bincount(row, minlength=len(lengths))
            fields = [
                batch.column(key).filter(pa.array(size > 0)),
                _lists(size[size > 0], entries.field("term").filter(pa.array(found)), arrow_schema.field(1).type),
                _lists(size[size > 0], pa.array(weight / norm[row]), arrow_schema.field(2).type),
            ]
            yield pa.RecordBatch.from_arrays(fields, schema=arrow_schema)

    return counted.mapInArrow(run, schema)


@dataclass(frozen=True)
class Asked:
    """The terms that queries hold, as distinct 64-bit hashes; a document's other terms count in its length only.

    Equal hashes of two terms only keep a term that is not asked for.
    """

    hashes: DataFrame

    @staticmethod
    def by(vectors: DataFrame) -> Asked | None:
        hashes = vectors.select(F.explode("terms").alias("term")).select(F.xxhash64("term").alias("hash")).distinct()
        hashes = written(hashes, "asked-terms")
        return Asked(hashes) if 8 * hashes.count() <= ASKED_BYTES else None


def _weigh_counted(counted: DataFrame, key: str, vocabulary: Vocabulary, asked: Asked | None) -> DataFrame:
    """Weigh the rows that the vocabulary was counted from: a term without an entry in ``repeated`` has df 1."""
    known = vocabulary.repeated.orderBy("hash").toArrow()
    wanted = np.sort(asked.hashes.toArrow().column("hash").to_numpy()) if asked else None
    held = counted.sparkSession.sparkContext.broadcast(
        (known.column("hash").to_numpy(), known.column("df").to_numpy().astype(np.uint32), wanted)
    )
    n_documents = vocabulary.n_documents
    schema = T.StructType(
        [
            counted.schema[key],
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("weights", T.ArrayType(T.DoubleType())),
        ]
    )
    arrow_schema = to_arrow_schema(schema)
    hashes = F.transform("counts", lambda entry: F.xxhash64(entry["term"]))
    rows = counted.select(key, "counts", hashes.alias("hashes"))

    def place(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_values, values), max(len(sorted_values) - 1, 0))
        return at, sorted_values[at] == values if len(sorted_values) else np.zeros(len(values), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, df, wanted = held.value
        for batch in batches:
            counts = batch.column("counts")
            lengths = pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False)
            entries = counts.flatten()
            own, entry = np.unique(batch.column("hashes").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            at, found = place(repeated, own)
            own_df = np.ones(len(own))
            own_df[found] = df[at[found]]
            idf = np.log((n_documents + 1) / (own_df + 1))
            row = np.repeat(np.arange(len(lengths)), lengths)
            weight = entries.field("tf").to_numpy(zero_copy_only=False) * idf[entry]
            norm = np.sqrt(np.bincount(row, weight * weight, len(lengths)))
            keep = (idf > 0) if wanted is None else (idf > 0) & place(wanted, own)[1]
            keep = keep[entry]
            size = np.bincount(row[keep], minlength=len(lengths))
            fields = [
                batch.column(key).filter(pa.array(size > 0)),
                _lists(size[size > 0], entries.field("term").filter(pa.array(keep)), arrow_schema.field(1).type),
                _lists(size[size > 0], pa.array(weight[keep] / norm[row[keep]]), arrow_schema.field(2).type),
            ]
            yield pa.RecordBatch.from_arrays(fields, schema=arrow_schema)

    return rows.mapInArrow(run, schema)


def _lists(lengths: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind)


def _weigh_counted_by_join(counted: DataFrame, key: str, vocabulary: Vocabulary, hot_terms: int, asked: Asked) -> DataFrame:
    """As :func:`_weigh_by_join`, of the rows that the vocabulary was counted from and the asked terms alone.

    Terms go by their hashes, counted once and written. Of those that are not asked for, only the sum of squares is gathered; the ``hot_terms`` most frequent are weighed
    where they are, so that little more than one row a text and task leaves it for them.
    """
    hashed = F.transform("counts", lambda entry: F.struct(F.xxhash64(entry["term"]).alias("hash"), entry["tf"].alias("tf")))
    entries = written(counted.select(key, hashed.alias("hashed")), "hashed-counts").select(key, F.inline("hashed"))
    hot = written(vocabulary.repeated.orderBy(F.col("df").desc(), "hash").limit(hot_terms), "hot-terms")
    names = vocabulary.rows.select("term").withColumn("hash", F.xxhash64("term")).join(F.broadcast(asked.hashes), "hash", "left_semi")
    names = F.broadcast(written(names, "asked-names"))
    cold = vocabulary.repeated.join(F.broadcast(hot.select("hash")), "hash", "left_anti")
    rare = entries.join(F.broadcast(hot.select("hash")), "hash", "left_anti")
    met = entries.join(F.broadcast(hot), "hash").unionByName(rare.join(cold, "hash", "left"))
    idf = F.log((F.lit(vocabulary.n_documents) + 1) / (F.coalesce("df", F.lit(1)) + 1))
    weighted = met.select(key, "hash", (F.col("tf") * idf).alias("weight")).where(F.col("weight") > 0).join(names, "hash", "left")
    listed = F.when(F.col("term").isNotNull(), F.struct("term", "weight"))
    gathered = weighted.groupBy(key).agg(
        F.sum(F.col("weight") * F.col("weight")).alias("squares"), F.sort_array(F.collect_list(listed)).alias("entries")
    )
    weights = F.transform(
        F.array(F.sqrt("squares")), lambda norm: F.transform("entries", lambda entry: entry["weight"] / norm)
    )[0]
    terms = F.transform("entries", lambda entry: entry["term"])
    return gathered.where(F.size("entries") > 0).select(key, terms.alias("terms"), weights.alias("weights"))


def _weigh_by_join(counted: DataFrame, key: str, vocabulary: Vocabulary, hot_terms: int) -> DataFrame:
    """Weigh against a vocabulary of any size by a join on the term.

    The ``hot_terms`` most frequent terms are broadcast and only the others shuffled, so that none of the
    terms every other text holds gathers in one task. A long term is broadcast as a digest, which bounds the
    size of the set whatever the terms are.
    """
    name = F.when(F.octet_length("term") > 64, F.sha2("term", 256)).otherwise(F.col("term"))
    entries = counted.select(key, F.inline("counts")).withColumn("name", name)
    terms = vocabulary.rows.withColumn("name", name)
    hot = terms.orderBy(F.col("df").desc(), "term").limit(hot_terms).select("name", "idf")
    cold = terms.join(F.broadcast(hot.select("name")), "name", "left_anti").select("term", "idf")
    rare = entries.join(F.broadcast(hot.select("name")), "name", "left_anti")
    weighted = entries.join(F.broadcast(hot), "name").drop("name").unionByName(rare.drop("name").join(cold, "term"))
    gathered = (
        weighted.select(key, "term", (F.col("tf") * F.col("idf")).alias("weight"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("entries"))
    )
    squares = F.aggregate(
        "entries", F.lit(0.0), lambda total, entry: total + entry["weight"] * entry["weight"]
    )
    weights = F.transform(
        F.array(F.sqrt(squares)),
        lambda norm: F.transform("entries", lambda entry: entry["weight"] / norm),
    )[0]
    return gathered.select(
        key, F.transform("entries", lambda entry: entry["term"]).alias("terms"), weights.alias("weights")
    )


def term_vectors(
    texts: DataFrame,
    key: str,
    text: str,
    vocabulary: Vocabulary,
    separators: str = SEPARATORS,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_terms: int = HOT_TERMS,
    asked: Asked | None = None,
    counted_from: bool = False,
) -> DataFrame:
    """``(key, terms, weights)``: unit TF-IDF vectors; texts without known terms are left out.

    Keys must be unique. With ``counted_from`` the texts must be those that the vocabulary was counted from: its terms of one
    document then need not be told to any task. ``asked`` leaves out entries, and texts of such alone, that no query asks for.
    """
    counted = spread_small_input(texts.select(key, text)).select(
        key, term_counts(F.col(text), separators).alias("counts")
    )
    if counted_from and vocabulary.repeated_bytes is not None:
        if 0 < broadcast_bytes and vocabulary.repeated_bytes <= broadcast_bytes:
            return _weigh_counted(counted, key, vocabulary, asked)
        if asked:
            return _weigh_counted_by_join(counted, key, vocabulary, hot_terms, asked)
    if vocabulary.n_bytes <= broadcast_bytes:
        return _weigh_in_place(counted, key, vocabulary)
    return _weigh_by_join(counted, key, vocabulary, hot_terms)


def topk_by_terms(
    queries: DataFrame,
    documents: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    query_text: str = "text",
    key: str = "key",
    text: str = "text",
    decimals: int = 4,
    separators: str = SEPARATORS,
    strategy: str = "auto",
    limits: Limits = Limits(),
    vocabulary: Vocabulary | None = None,
    vocabulary_bytes: int = BROADCAST_BYTES,
) -> Matches:
    """The ``k`` documents of largest TF-IDF cosine for every query text.

    Queries are weighted by the document vocabulary, which is broadcast up to ``vocabulary_bytes`` and joined
    beyond. Only documents that share a weighted term with the query match. Documents are cut down to the terms that queries hold.
    """
    own = vocabulary is None
    vocabulary = vocabulary or build_vocabulary(documents, text, separators)
    asked_vectors = written(
        term_vectors(queries, query_id, query_text, vocabulary, separators, vocabulary_bytes), "query-vectors"
    )
    asked = Asked.by(asked_vectors) if own else None

    def side(df: DataFrame, name: str, body: str, rows: DataFrame) -> Side:
        def bytes_for(n_rows: int) -> int:
            # A term needs two bytes of text and takes at most its own bytes, a weight and offsets.
            length = df.agg(F.coalesce(F.sum(F.octet_length(body).cast("long")), F.lit(0))).first()[0]
            return 8 * length + 16 * n_rows

        return Side(rows, name, df, bytes_for)

    held = term_vectors(documents, key, text, vocabulary, separators, vocabulary_bytes, asked=asked, counted_from=own)
    return search(
        side(queries, query_id, query_text, asked_vectors),
        side(documents, key, text, held),
        k,
        SparseKernel(),
        decimals,
        strategy,
        limits,
    )
