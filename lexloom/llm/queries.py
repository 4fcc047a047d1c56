"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import (
    extraction,
    fpsearch,
    linededup,
    mixing,
    neardup,
    ngrams,
    pieces,
    quality,
    repetition,
    secretscan,
    spelling,
    toxicity,
    vafile,
)

#: Where the public tokenizer files are installed on every machine.
TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTERED[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_line_dedup(spark, folder):
    found = linededup.line_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "text", "lines_removed")


@query
def op2_quality_classifier(spark, folder):
    found = quality.classify_quality(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    )
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op3_sentencepiece(spark, folder):
    encoded = pieces.encode_and_check(table(spark, folder, "documents").select("doc_id", "text"), PIECE_MODEL)
    return encoded.select("doc_id", "pieces", F.size("pieces").alias("n_pieces"), "round_trip")


@query
def op4_va_top_k(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = rows.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long")).alias("vector")
    )
    return vafile.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


@query
def op5_ngram_scores(spark, folder):
    return ngrams.score_texts(table(spark, folder, "documents"), s=ngrams.Settings(order=3))


@query
def op6_html_extraction(spark, folder):
    return extraction.extract_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op7_mix_sources(spark, folder):
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


@query
def op8_minhash_near_dedup(spark, folder):
    found = neardup.near_duplicates(table(spark, folder, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op9_repetition_rules(spark, folder):
    return repetition.repetition_rules(table(spark, folder, "documents")).drop("longest_repeat")


@query
def op10_toxicity(spark, folder):
    found = toxicity.classify_toxicity(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    )
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op11_spelling_variants(spark, folder):
    return spelling.group_spellings(table(spark, folder, "documents"))


@query
def op12_ranked_search(spark, folder):
    return fpsearch.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_secret_scan(spark, folder):
    rules = secretscan.RULES
    found = secretscan.scan_secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["place"] < len(secretscan.BASE_RULES))
    of_kind = lambda place: F.size(F.filter("spans", lambda s: s["place"] == place)).cast("long")
    return found.select(
        "doc_id",
        *(of_kind(place).alias(f"n_{rule.kind}") for place, rule in enumerate(secretscan.BASE_RULES)),
        F.sha2(secretscan.written(base, rules), 256).alias("base_sha256"),
        secretscan.written(F.col("spans"), rules).alias("spans"),
    )
