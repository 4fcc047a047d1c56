"""From raw documents to encoded training text: five stages, each one operator of ``lexloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next
one reads it. All but the last return the columns of ``documents``. ``run`` applies them in order.

No stage drops a row because its key, source or another column is null; rows with a null key are no one's near-duplicates. A null text counts as an
empty one: it is scored as a text without words, loses no lines, has no near-duplicates, size 0 in the mix and no pieces. Repeated rows are judged
alike; the near-duplicate stage keeps all rows of a key that it keeps.
Very long texts are read whole. An empty table stays empty. Columns beyond those of ``documents`` are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import linededup, mixing, neardup, pieces, quality
from lexloom.llm.queries import PIECE_MODEL, table
from lexloom.llm.storage import free_name, stored

KEEP_FROM = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below ``KEEP_FROM``; the rest stay as they are."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    column = free_name(docs, "score")
    return quality.score(docs, model, column=column).where(F.col(column) >= KEEP_FROM).drop(column)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove runs of lines that stand in an earlier place; a document left without a word goes.

    Only a document that lost lines can go: all its words then stand in other documents. ``n_chars`` of texts that lost lines is counted again.
    """
    columns = docs.columns
    deduped = linededup.line_dedup(docs)
    left = F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    kept = deduped.where((F.col("lines_removed") == 0) | left)
    if "n_chars" in columns:
        changed = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed)
    return kept.select(*columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest key of every group of near-duplicates."""
    name = free_name(docs, "id")
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[name]), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as its source's rate asks for."""
    return mixing.emit_copies(mixing.mix_sources(docs))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of each text, and whether they decode to it."""
    encoded = pieces.encode_and_check(docs.select("doc_id", "source", "text"), PIECE_MODEL)
    return encoded.select("doc_id", "source", "pieces", F.size("pieces").alias("n_pieces"), "round_trip")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_each),
    ("source mixing", mix),
    ("sentencepiece", to_pieces),
]

#: The classifier's scores and the hashes of the line chunks have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
