"""One query per operator; each reads whole tables from a folder of Parquet files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import languages as lang
from lexloom.functions import responses, text, vectors
from lexloom.functions.hints import hint_block_column
from lexloom.operators import (
    chunking,
    clean,
    context,
    embed,
    language,
    ledger,
    profile,
    requests,
    retrieval,
    sentences,
    sketches,
    sparse,
    termjoin,
)
from lexloom.operators.blocks import Limits, Matches
from lexloom.plans.etl import load_incidents, load_sections
from lexloom.plans.guidance import answers, apply_translation_calls, apply_translations, guidance
from lexloom.plans.index import build_index, update_index
from lexloom.session import shared_dir, spread_small_input, written
from lexloom.sources import csv, csvparts, tables
from lexloom.sources.vectors import read_embedding_table
from lexloom.sources.versions import VersionedTable
from lexloom.streaming.retrieval import BatchLog, serve_records, stream_guidance, stream_topk

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

PROFILE_LANGUAGES = ("de", "en", "es", "fr")

# Stand-ins that let the four languages of the test texts exercise every route.
LANGUAGE_NAMES = {"en": "English", "fr": "Hindi", "de": "Tamil", "es": "Marathi"}
TARGET_LOCALES = {"en": "hi-IN", "fr": "en-IN", "de": "en-IN", "es": "mr-IN"}

#: Statuses of the attempts of a call, by the way it goes.
CALL_WAYS = ((), (500, 500, 503), (200,), (500, 200), (429,))
LEDGER_WAYS = ((), (500, 200), (500, 503, 502), (400,), (200, 200), (429,), (200,), (200, 500))


def query(run: Query) -> Query:
    REGISTERED[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_lang(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])[F.col("lang")]


# Cleaning


@query
def clean_documents(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return clean.clean_text_rows(
        documents, "text", longer_than=20, trim=("source",), flatten=True, header_column="source"
    )


@query
def clean_short_text(spark, folder):
    return clean.clean_text_rows(table(spark, folder, "conversations"), "text", longer_than=5, trim=("role",))


@query
def normalise_headers(spark, folder):
    messy = table(spark, folder, "customer").toDF(
        " c__custkey ", "c name_", "_c_\tnationkey", "c _ acctbal", "c_mktsegment"
    )
    return clean.normalise_headers(messy)


# Sources and sinks


@query
def csv_quoted_scan(spark, folder):
    path = shared_dir(spark, "csv")
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    csv.write_csv(documents.toDF(" doc__id", "text ", "lang", "source_"), path)
    raw = clean.normalise_headers(csv.read_quoted_csv(spark, path))
    return clean.clean_text_rows(raw, "text", longer_than=20, trim=("source",), flatten=True)


@query
def csv_split_scan(spark, folder):
    """The same rows from files that are read in ranges of a megabyte, whose borders fall into records."""
    path = shared_dir(spark, "csv")
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    csv.write_csv(documents.toDF(" doc__id", "text ", "lang", "source_"), path)
    raw = clean.normalise_headers(csvparts.read_quoted_csv_in_parts(spark, path, split_bytes=1 << 20))
    return clean.clean_text_rows(raw, "text", longer_than=20, trim=("source",), flatten=True)


@query
def csv_plain_scan(spark, folder):
    path = shared_dir(spark, "csv")
    csv.write_csv(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type"), path)
    schema = csv.string_schema("p_partkey", "p_name", "p_brand", "p_type")
    return clean.clean_text_rows(
        csv.read_plain_csv(spark, path, schema), "p_name", longer_than=5, trim=("p_type",)
    )


def _written_part(spark: SparkSession, folder: str, **options) -> str:
    schema = f"lexloom_{uuid.uuid4().hex[:12]}"
    tables.ensure_schema(spark, schema, shared_dir(spark, "schema"))
    tables.write_table(table(spark, folder, "part"), f"{schema}.part", **options)
    return f"{schema}.part"


@query
def table_roundtrip(spark, folder):
    return tables.read_table(spark, _written_part(spark, folder))


@query
def table_statistics(spark, folder):
    name = _written_part(spark, folder)
    tables.compute_statistics(spark, name)
    figures = tables.column_statistics(spark, name)
    known = figures.where(F.col("value") != "NULL")
    # The catalog's distinct counts are estimates with a standard error of 5 %: shown is whether they are within three of these.
    part = table(spark, folder, "part")
    counts = part.agg(*[F.count_distinct(name).alias(name) for name in part.columns])
    exact = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("exact")) for name in part.columns])
    near = F.abs(F.col("value").cast("double") - F.col("exact")) <= 0.15 * F.col("exact")
    shown = F.when(F.col("statistic") == "distinct_count", near.cast("string")).otherwise(F.col("value"))
    return known.join(counts.select(F.inline(exact)), "column").select("column", "statistic", shown.alias("value"))


@query
def compact_table(spark, folder):
    name = _written_part(spark, folder, partition_by=("p_brand",))
    tables.set_write_properties(spark, name, {"write.optimize": "true"})
    tables.compute_statistics(spark, name)
    tables.compact_table(spark, name)
    return tables.read_table(spark, name).withColumns(
        {
            "partitioned_by": F.lit(",".join(tables.partition_columns(spark, name))),
            "optimize": F.lit(tables.write_properties(spark, name).get("write.optimize")),
            "measured": F.lit(tables.has_statistics(spark, name)),
        }
    )


@query
def table_versions(spark, folder):
    """Two versions with different columns side by side, after a third write whose check failed."""
    parts = VersionedTable(spark, shared_dir(spark, "versions"))
    part = table(spark, folder, "part")
    first = parts.write(part).number
    changed = part.where("p_size > 10").drop("p_type").withColumn("p_area", F.col("p_size") * 2)
    second = parts.write(changed, ("p_brand",)).number

    def refuse(figures: dict) -> None:
        raise ValueError(f"{figures['rows']} rows")

    try:
        parts.write(part.limit(1), check=refuse)
    except ValueError:
        pass
    both = parts.read(first).withColumn("version", F.lit(first)).unionByName(
        parts.read(second).withColumn("version", F.lit(second)), allowMissingColumns=True
    )
    return both.withColumn("is_current", F.col("version") == parts.current())


@query
def table_compaction(spark, folder):
    """Every partition has one large file and two small ones; the small ones are merged, the large ones stay."""
    parts = VersionedTable(spark, shared_dir(spark, "versions"))
    part = table(spark, folder, "part")
    large, small = part.where("p_size > 10"), (part.where("p_size <= 5"), part.where("p_size between 6 and 10"))
    parts.write(large.repartition("p_brand"), ("p_brand",), {"owner": "catalog"})
    for rows in small:
        parts.append(rows.repartition("p_brand"))
    before = parts.files().select("file", "p_brand", "file_bytes")
    largest = before.groupBy("p_brand").agg(F.max_by("file", "file_bytes").alias("file"), F.max("file_bytes").alias("most"))
    least, most = largest.agg(F.min("most"), F.max("most")).first()
    small_file = F.col("file_bytes") < least
    expected = before.groupBy("p_brand").agg((F.count_if(~small_file) + F.max(small_file.cast("int"))).alias("expected"))
    expected = written(expected, "expected-files")
    # Two small files of a partition always fit one pack of this size.
    done = parts.compact(target_bytes=3 * most, small_below=(least - 0.5) / (3 * most))
    after = parts.files().select("file", "p_brand")
    kept = largest.join(after.select("file"), "file", "left_semi").groupBy("p_brand").agg(F.count("*").alias("largest_kept"))
    sums = after.groupBy("p_brand").agg(F.count("*").alias("files")).join(expected, "p_brand")
    checked = sums.join(kept, "p_brand").select("p_brand", (F.col("files") == F.col("expected")).alias("merged"), "largest_kept")
    return parts.read(done.number).join(checked, "p_brand").withColumns(
        {"partitioned_by": F.lit(",".join(done.partition_by)), "owner": F.lit(done.properties["owner"])}
    )


@query
def column_sketches(spark, folder):
    """Sketches of every source's documents, merged: counts, and whether the estimates are as close as they should be."""
    documents = table(spark, folder, "documents")
    parts = written(sketches.column_sketches(documents, by=("source",)), "sketches")
    merged = sketches.merge_sketches(parts)
    names = [name for name in documents.columns if name != "source"]
    exact = documents.agg(*[F.count_distinct(name).alias(name) for name in names])
    listed = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("distinct_exact")) for name in names])
    middle = merged.select("column", F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(0.5)).alias("middle")).where(
        F.col("quantile_sketch").isNotNull()
    )
    middles = {r["column"]: r["middle"] for r in middle.collect()}  # one number a numeric column
    below = documents.agg(*[F.avg((F.col(name) <= value).cast("double")).alias(name) for name, value in middles.items()])
    ranks = below.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("rank")) for n in middles])))
    joined = merged.join(exact.select(F.inline(listed)), "column").join(ranks, "column", "left")
    close = F.abs(F.hll_sketch_estimate("distinct_sketch") - F.col("distinct_exact")) <= 0.04 * F.col("distinct_exact")
    return joined.select(
        "column",
        "rows",
        "nulls",
        "bytes",
        F.when(F.col("number"), F.col("low")).alias("low"),
        F.when(F.col("number"), F.col("high")).alias("high"),
        "distinct_exact",
        close.alias("distinct_close"),
        (F.abs(F.col("rank") - 0.5) <= 0.02).alias("median_close"),
    )


@query
def etl_sections(spark, folder):
    """Quoted CSV to a table, as one job: the rows of the table with the count of their group."""
    path, schema = shared_dir(spark, "csv"), f"lexloom_{uuid.uuid4().hex[:12]}"
    documents = table(spark, folder, "documents")
    sections = documents.select(
        F.col("lang").alias("Chapter "), F.col("source").alias("Chapter__name"), F.lit(None).cast("string").alias("Chapter_subtype"),
        F.col("doc_id").cast("string").alias("Section"), F.concat(F.lit(" "), "source").alias("Section _name"), F.col("text").alias("Description"),
    )
    csv.write_csv(sections, path)
    tables.ensure_schema(spark, schema, shared_dir(spark, "schema"))
    loaded = load_sections(spark, path, f"{schema}.sections")
    counted = loaded.profile.withColumnRenamed("sections", "in_chapter")
    rows = spark.table(loaded.table).join(F.broadcast(counted), "Chapter_name")
    return rows.withColumn("loaded", F.lit(loaded.rows).cast("long"))


@query
def etl_incidents(spark, folder):
    """Plain CSV to a table, as one job: the group counts of the table."""
    path, schema = shared_dir(spark, "csv"), f"lexloom_{uuid.uuid4().hex[:12]}"
    part = table(spark, folder, "part")
    csv.write_csv(part.select(F.col("p_name").alias("incident_description"), F.col("p_type").alias("offense_type")), path)
    tables.ensure_schema(spark, schema, shared_dir(spark, "schema"))
    loaded = load_incidents(spark, path, f"{schema}.incidents")
    return loaded.profile.withColumn("loaded", F.lit(loaded.rows).cast("long"))


@query
def table_preview(spark, folder):
    return profile.table_preview(table(spark, folder, "documents"), "doc_id", n=10, width=80)


@query
def index_build(spark, folder):
    path = shared_dir(spark, "embeddings")
    counts = build_index(table(spark, folder, "documents"), path, _load_letter_model, "source", "text")
    return read_embedding_table(spark, path).select(
        "doc_id",
        F.size("embedding").alias("dimension"),
        F.round(F.get("embedding", F.lit(4)).cast("double"), 4).alias("fifth_element"),
        F.lit(counts["stored"]).alias("stored"),
        F.lit(counts["rejected"]).alias("rejected"),
    )


@query
def index_update(spark, folder):
    """An index of an earlier state of the documents, brought up to date: the rows of a full build, and what had changed."""
    path = shared_dir(spark, "embeddings")
    documents = table(spark, folder, "documents")
    earlier = documents.where("doc_id % 11 <> 3").withColumns(
        {
            "text": F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit(" earlier"))).otherwise(F.col("text")),
            "lang": F.when(F.col("doc_id") % 13 == 2, F.lit("xx")).otherwise(F.col("lang")),
        }
    )
    gone = documents.where("doc_id % 17 = 5").withColumn("doc_id", -F.col("doc_id"))
    build = lambda rows: update_index(rows, path, _load_letter_model, "doc_id", "source", "text")
    build(earlier.unionByName(gone))
    figures = build(documents)
    counts = [F.lit(figures[name]).cast("long").alias(f"n_{name}") for name in ("new", "changed", "edited", "gone", "same", "embedded")]
    return read_embedding_table(spark, path).select(
        "doc_id", "lang", F.size("embedding").alias("dimension"), F.round(F.get("embedding", F.lit(4)).cast("double"), 4).alias("fifth_element"), *counts
    )


# Profiles


@query
def count_rows(spark, folder):
    return profile.row_count(table(spark, folder, "documents"))


@query
def count_by_source_asc(spark, folder):
    return profile.count_by(table(spark, folder, "documents"), "source", "sections")


@query
def count_by_lang_desc(spark, folder):
    return profile.count_by(table(spark, folder, "documents"), "lang", "count", by_count=True)


# Vectors


@query
def embed_text(spark, folder):
    name_and_body = text.embedding_text(F.col("source"), F.col("text"))
    return table(spark, folder, "documents").select("doc_id", name_and_body.alias("embedding_text"))


def _load_letter_model():
    """A stand-in model: how often each of the letters a to z occurs."""

    def encode(texts: np.ndarray) -> np.ndarray:
        counts = [
            np.bincount(np.frombuffer(body.encode("utf-8"), np.uint8), minlength=256)[97:123] for body in texts
        ]
        return np.stack(counts)

    return encode


@query
def embed_model(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    embedded = embed.embed_texts(documents, "text", _load_letter_model, batch_size=64)
    return embedded.select("doc_id", F.posexplode("embedding").alias("pos", "element")).select(
        "doc_id", "pos", F.round(F.col("element").cast("double"), 4).alias("value")
    )


@query
def l2_normalise(spark, folder):
    scaled = table(spark, folder, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda x: (x * 3).cast("float"))
    )
    unit = scaled.select("vec_id", F.posexplode(vectors.l2_normalise(F.col("embedding"))).alias("pos", "element"))
    return unit.select("vec_id", "pos", F.round(F.col("element").cast("double"), 4).alias("value"))


def _first_per_label(embeddings: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("vec_id", "embedding"), "vec_id")
    return embeddings.groupBy("label").agg(first.alias("first")).select("label", "first.*")


@query
def inner_product(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    first = _first_per_label(embeddings).select("label", F.col("embedding").alias("first"))
    product = vectors.inner_product(F.col("embedding"), F.col("first"))
    return embeddings.join(first, "label").select("vec_id", "label", F.round(product, 6).alias("product"))


# Dense retrieval


def _topk(spark: SparkSession, folder: str, k: int) -> Matches:
    embeddings = table(spark, folder, "embeddings")
    return retrieval.topk(embeddings, embeddings, k, query_id="vec_id", key="vec_id")


def _register_topk(k: int) -> None:
    def run(spark, folder):
        return _topk(spark, folder, k).rows

    REGISTERED[f"topk_cosine_k{k}"] = run


for _k in (3, 5, 7, 10):
    _register_topk(_k)


# The same search by each way of bringing the sides together, whatever their sizes.
WAYS = {
    "queries": {"strategy": "queries"},
    "corpus": {"strategy": "corpus"},
    "waves": {"strategy": "waves", "limits": Limits(broadcast_bytes=100_000)},
}


def _register_ways(way: str) -> None:
    def dense(spark, folder):
        embeddings = table(spark, folder, "embeddings")
        return retrieval.topk(embeddings, embeddings, 5, query_id="vec_id", key="vec_id", **WAYS[way]).rows

    def by_terms(spark, folder):
        asked, documents = table(spark, folder, "benchmark"), table(spark, folder, "documents")
        return sparse.topk_by_terms(asked, documents, 5, query_id="item_id", key="doc_id", **WAYS[way]).rows

    REGISTERED[f"topk_cosine_k5_{way}"] = dense
    if way == "waves":
        REGISTERED[f"sparse_retrieval_k5_{way}"] = by_terms


for _way in WAYS:
    _register_ways(_way)


@query
def topk_per_request(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    asking = embeddings.withColumn("k", F.col("vec_id") % 8 + 3)
    return retrieval.topk_per_request(asking, embeddings, "k", query_id="vec_id", key="vec_id").rows


@query
def topk_short_corpus(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    few = _first_per_label(embeddings).select("vec_id", "embedding")
    return retrieval.topk(embeddings, few, 100, query_id="vec_id", key="vec_id").rows


def _records(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    return retrieval.attach_records(_topk(spark, folder, k), table(spark, folder, "documents"), "doc_id")


@query
def retrieve_records(spark, folder):
    columns = ("query_id", "rank", "key", "similarity", "source", "lang", "n_chars")
    return _records(spark, folder).select(*columns)


@query
def match_display(spark, folder):
    return context.match_display(_records(spark, folder), "key", "source", "text")


@query
def retrieval_hit_rate(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    found = retrieval.topk_others(embeddings, embeddings, 5, query_id="vec_id", key="vec_id")
    rates = retrieval.hit_rate(found, embeddings, "vec_id", "label")
    return rates.withColumn("hit_rate", F.round("hit_rate", 6))


@query
def retrieval_context(spark, folder):
    return context.retrieval_context(_records(spark, folder), "key", "source", "text")


@query
def hint_block(spark, folder):
    typed = table(spark, folder, "conversations").select("conv_id", "turn")
    return typed.withColumn("hint_block", hint_block_column(spark))


def _vectors(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias(key), "embedding")


@query
def chat_requests(spark, folder):
    query_vectors = _vectors(spark, folder, "request_id")
    documents = table(spark, folder, "documents")
    inputs = documents.select(F.col("doc_id").alias("request_id"), "text")
    sent = guidance(
        inputs,
        _vectors(spark, folder, "doc_id"),
        "doc_id",
        "source",
        "text",
        query_text="text",
        query_vectors=query_vectors,
        records=documents,
    )
    return context.message_rows(sent)


@query
def explanation_requests(spark, folder):
    sent = context.explanation_requests(table(spark, folder, "documents"), "doc_id", "text")
    return context.message_rows(sent)


# Sparse retrieval


@query
def sparse_retrieval_k5(spark, folder):
    return sparse.topk_by_terms(
        table(spark, folder, "benchmark"),
        table(spark, folder, "documents"),
        5,
        query_id="item_id",
        key="doc_id",
    ).rows


@query
def sparse_retrieval_k5_term_join(spark, folder):
    asked, documents = table(spark, folder, "benchmark"), table(spark, folder, "documents")
    return termjoin.topk_by_term_join(asked, documents, 5, query_id="item_id", key="doc_id").rows


@query
def sparse_retrieval_k5_large_vocabulary(spark, folder):
    """Terms are weighed by a join, as for a vocabulary that is too large to broadcast."""
    asked, documents = table(spark, folder, "benchmark"), table(spark, folder, "documents")
    return sparse.topk_by_terms(asked, documents, 5, query_id="item_id", key="doc_id", vocabulary_bytes=0).rows


# Chunks


@query
def chunk_900(spark, folder):
    chunks = text.paragraph_chunks(F.col("text"))
    documents = spread_small_input(table(spark, folder, "documents").select("doc_id", "text"))
    return chunking.explode_chunks(documents, chunks, "doc_id")


@query
def chunk_rejoin(spark, folder):
    chunks = chunk_900(spark, folder).withColumn("chunk", F.concat(F.lit("["), "chunk", F.lit("]")))
    return chunking.join_chunks(chunks, "doc_id")


@query
def chunk_120_hard(spark, folder):
    """No chunk is longer than 120 characters: sentences beyond that are cut."""
    documents = spread_small_input(table(spark, folder, "documents").select("doc_id", "text"))
    return chunking.explode_chunks(documents, text.paragraph_chunks(F.col("text"), 120, hard=True), "doc_id")


@query
def abbreviation_counts(spark, folder):
    return sentences.abbreviation_counts(table(spark, folder, "documents"), "text")


def _first_sentence_chunks(spark: SparkSession, folder: str, n: int) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    chunked = spread_small_input(documents).select(
        "doc_id", text.sentence_chunks(F.col("text")).alias("chunks")
    )
    kept = chunked.select(
        "doc_id",
        text.n_dropped(F.col("chunks"), n).alias("n_dropped"),
        text.first_chunks(F.col("chunks"), n).alias("chunks"),
    )
    return chunking.explode_chunks(kept, F.col("chunks"), "doc_id", "n_dropped")


@query
def sentence_chunks_480_first3(spark, folder):
    return _first_sentence_chunks(spark, folder, 3)


@query
def sentence_chunks_480_first6(spark, folder):
    return _first_sentence_chunks(spark, folder, 6)


@query
def speech_requests(spark, folder):
    documents = table(spark, folder, "documents")
    locale = lang.locale_code(by_lang(LANGUAGE_NAMES))
    sent = requests.speech_requests(documents, "doc_id", "text", locale)
    return sent.select(
        "doc_id",
        "n_dropped",
        F.size("payload.inputs").alias("n_inputs"),
        F.array_join("payload.inputs", "|").alias("inputs"),
        "payload.target_language_code",
        "payload.speaker",
        "payload.speech_sample_rate",
        "payload.model",
    )


# Requests and responses


@query
def previews(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        *[
            text.preview(F.col("text"), n).alias(f"first_{n}")
            for n in (context.ORIGINAL_PREVIEW, context.PROMPT_PREVIEW, context.DISPLAY_PREVIEW)
        ],
    )


@query
def resolve_input(spark, folder):
    turns = table(spark, folder, "conversations")
    offered = turns.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.col("text")).alias("typed"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("transcript"),
    )
    return requests.resolve_requests(offered, "typed", "transcript").select(
        "conv_id", "turn", "resolved", "accepted"
    )


@query
def translate_plan(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id",
        "text",
        by_lang(LANGUAGE_NAMES).alias("language"),
        by_lang(TARGET_LOCALES).alias("target"),
        (F.col("n_chars") > 1000).alias("has_key"),
    )
    planned = requests.plan_languages(documents, "language", "has_key")
    wanted = lang.needs_translation(F.col("text"), F.col("locale"), F.col("target"), F.col("has_key"))
    return planned.select(
        "doc_id",
        "language",
        "locale",
        lang.iso_code(F.col("language")).alias("iso"),
        "target",
        "multilingual",
        wanted.alias("wanted"),
    )


@query
def rejected_requests(spark, folder):
    named = table(spark, folder, "documents").select(
        "doc_id", by_lang({"en": "English", "fr": "Urdu", "de": "hindi"}).alias("language")
    )
    return requests.unsupported(requests.plan_languages(named, "language"))


@query
def transcript_requests(spark, folder):
    """Users' turns stand for wave files, the assistant's for other sound, the system's have none."""
    sound = F.when(F.col("role") == "user", F.concat(F.lit("RIFF"), "text")).when(F.col("role") == "assistant", F.col("text"))
    turns = table(spark, folder, "conversations").withColumns(
        {"request_id": F.concat_ws("-", "conv_id", "turn"), "sound": sound.cast("binary")}
    )
    sent = requests.transcript_requests(turns, "request_id", "sound", lang.locale_code(F.lit("Hindi")))
    return sent.select("request_id", "payload.*")


@query
def translate_requests(spark, folder):
    documents = table(spark, folder, "documents")
    source = lang.locale_code(by_lang(LANGUAGE_NAMES))
    sent = requests.translation_requests(documents, "doc_id", "text", source, by_lang(TARGET_LOCALES))
    return sent.select("doc_id", "chunk_no", "payload.*", F.to_json("payload").contains('"mode"').alias("sends_mode"))


@query
def response_extract(spark, folder):
    turns = table(spark, folder, "conversations")
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    answered = turns.select(
        "conv_id",
        "turn",
        "role",
        F.to_json(F.struct(F.array(message).alias("choices"))).alias("chat"),
        F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("translated_text"))))
        .otherwise(F.lit("{}"))
        .alias("translation"),
        F.to_json(F.struct(F.col("text").alias("transcript"))).alias("speech"),
        F.to_json(F.struct(F.array("role", "text").alias("audios"))).alias("sound"),
    )
    return answered.select(
        "conv_id",
        "turn",
        responses.chat_content(F.col("chat")).alias("content"),
        responses.translated_text(F.col("translation"), F.col("role")).alias("translated"),
        responses.transcript(F.col("speech")).alias("transcript"),
        F.array_join(responses.audios(F.col("sound")), "|").alias("audios"),
    )


@query
def guidance_answers(spark, folder):
    """Users' turns are requests; the assistant's next turn responds to them, if there is one."""
    turns = table(spark, folder, "conversations")
    name = F.concat_ws("-", "conv_id", F.col("turn"))
    asked = turns.where("role = 'user'").select(name.alias("request_id"), F.col("text").alias("resolved"))
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    earlier = F.concat_ws("-", "conv_id", F.col("turn") - 1)
    responded = turns.where("role = 'assistant'").select(
        earlier.alias("request_id"), F.to_json(F.struct(F.array(message).alias("choices"))).alias("response")
    )
    return answers(asked, responded).select("request_id", "resolved", "answer", "status")


@query
def translated_answers(spark, folder):
    """Documents sent for translation in chunks of which every third is not answered, put together again."""
    documents = table(spark, folder, "documents")
    source = lang.locale_code(by_lang(LANGUAGE_NAMES))
    sent = written(requests.translation_requests(documents, "doc_id", "text", source, by_lang(TARGET_LOCALES)), "sent")
    translation = F.to_json(F.struct(F.concat(F.lit("["), "payload.input", F.lit("]")).alias("translated_text")))
    answered = sent.select(
        "doc_id", "chunk_no", F.when(F.col("chunk_no") % 3 == 1, F.lit("{}")).otherwise(translation).alias("response")
    ).where("chunk_no % 3 < 2")
    final = apply_translations(documents.select("doc_id", "text"), "doc_id", "text", sent, answered)
    return final.select("doc_id", "translated", "n_untranslated")


@query
def translation_calls(spark, folder):
    """Documents whose chunks are calls that end in five ways, by the length of the chunk: see ``CALL_WAYS``."""
    documents = table(spark, folder, "documents")
    source = lang.locale_code(by_lang(LANGUAGE_NAMES))
    sent = written(requests.translation_requests(documents, "doc_id", "text", source, by_lang(TARGET_LOCALES)), "sent")
    once = ledger.calls(ledger.keyed(sent))
    statuses = F.get(F.array(*[F.array(*map(F.lit, codes)).cast("array<int>") for codes in CALL_WAYS]), F.length("payload.input") % 5)
    tried = once.select(ledger.REQUEST_KEY, "payload", F.posexplode(statuses).alias("pos", "status"))
    body = F.to_json(F.struct(F.concat(F.lit("["), "payload.input", F.lit("]")).alias("translated_text")))
    came = tried.select(
        ledger.REQUEST_KEY, "status", (F.col("pos") + 1).alias("attempt"), F.col("pos").cast("long").alias("received"), body.alias("response")
    )
    applied = apply_translation_calls(documents.select("doc_id", "text"), "doc_id", "text", sent, written(came, "responses"))
    given_up = applied.given_up.groupBy("doc_id").agg(F.count("*").alias("n_dead"))
    return applied.texts.join(given_up, "doc_id", "left").select(
        "doc_id", "translated", "n_untranslated", "status", F.coalesce("n_dead", F.lit(0)).alias("n_dead")
    )


@query
def request_ledger(spark, folder):
    """Turns as calls that come back in eight ways: not at all, late, failed, given up, twice, busy, empty, or good and then failed."""
    turns = table(spark, folder, "conversations").withColumn("way", (F.col("conv_id") * 31 + F.col("turn")) % 8)
    asked = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.struct(F.col("text").alias("input"), "role").alias("payload"), "conv_id", "way"
    )
    asked = ledger.keyed(asked)
    statuses = F.get(F.array(*[F.array(*map(F.lit, codes)).cast("array<int>") for codes in LEDGER_WAYS]), F.col("way").cast("int"))
    tried = asked.select(ledger.REQUEST_KEY, "payload", "conv_id", "way", F.posexplode(statuses).alias("pos", "status"))
    body = F.to_json(F.struct(F.concat("payload.input", F.lit(" #"), F.col("pos").cast("string")).alias("translated_text")))
    responses_ = tried.select(
        ledger.REQUEST_KEY,
        "status",
        (F.col("pos") + 1).alias("attempt"),
        (F.col("conv_id") * 100 + F.col("pos")).alias("received"),
        F.when(F.col("way") == 6, F.lit("{}")).otherwise(body).alias("response"),
    )
    no_text = F.lit(None).cast("string")
    states = ledger.call_states(asked, responses_, responses.translated_text(F.col("response"), no_text).isNotNull())
    states = written(states, "call-states")
    given_up = ledger.dead_letters(asked, states).select("request_id", F.lit(True).alias("dead"))
    waiting = ledger.to_send(asked, states).select(ledger.REQUEST_KEY, "n_requests", F.col("attempt").alias("next_attempt"))
    served = ledger.responded(asked, states).join(given_up, "request_id", "left").join(waiting, ledger.REQUEST_KEY, "left")
    return served.select(
        "request_id",
        "state",
        "attempts",
        "last_status",
        responses.translated_text(F.col("response"), no_text).alias("translated"),
        F.coalesce("dead", F.lit(False)).alias("dead"),
        "n_requests",
        "next_attempt",
    )


@query
def response_defaults(spark, folder):
    props = F.col("props")
    return table(spark, folder, "events").select(
        "event_id",
        responses.chat_content(props).alias("content"),
        responses.translated_text(props, F.col("event_type")).alias("translated"),
        responses.transcript(props).alias("transcript"),
        F.size(responses.audios(props)).alias("n_audios"),
    )


# Language


def _profile(spark: SparkSession, folder: str) -> language.Profile:
    return language.train_profile(table(spark, folder, "documents"), "text", "lang", PROFILE_LANGUAGES)


@query
def lang_detect(spark, folder):
    turns = table(spark, folder, "conversations")
    return language.detect_language(turns, "conv_id", "text", _profile(spark, folder), keep=("turn",))


@query
def lang_detect_stored(spark, folder):
    """Counts of two batches, one profile made of both, kept and loaded."""
    documents, folder_of_profiles = table(spark, folder, "documents"), shared_dir(spark, "profiles")
    store = language.ProfileStore(spark, folder_of_profiles)
    for number in (0, 1):
        store.learn(f"half-{number}", documents.where(F.pmod("doc_id", F.lit(2)) == number), "text", "lang", PROFILE_LANGUAGES)
    store.build()
    loaded = language.ProfileStore(spark, folder_of_profiles).load()
    return language.detect_language(table(spark, folder, "conversations"), "conv_id", "text", loaded, keep=("turn",))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    # Every document is judged by a profile of the other half, which has not seen it.
    documents, half = table(spark, folder, "documents"), F.pmod("doc_id", F.lit(2))
    judged = [
        language.detect_language(
            documents.where(half == number),
            "doc_id",
            "text",
            language.train_profile(documents.where(half != number), "text", "lang", PROFILE_LANGUAGES),
            keep=("lang",),
        )
        for number in (0, 1)
    ]
    detected = judged[0].unionAll(judged[1])
    expected = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))
    return language.score_languages(detected, expected)


@query
def lang_score(spark, folder):
    return _scores(spark, folder).drop("lang")


@query
def lang_bench(spark, folder):
    report = language.language_report(_scores(spark, folder))
    return report.withColumn("mean_composite", F.round("mean_composite", 6))


@query
def lang_confusion(spark, folder):
    return language.confusion(_scores(spark, folder))


# Streams


def _request_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    # The bracket makes the path a pattern: as a plain path, a single file cannot feed a stream.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


@query
def stream_retrieval(spark, folder):
    out = shared_dir(spark, "stream-out")
    running = stream_topk(
        _request_stream(spark, folder, "embeddings"),
        lambda: table(spark, folder, "embeddings"),
        out,
        shared_dir(spark, "stream-state"),
        k=5,
        query_id="vec_id",
        key="vec_id",
    )
    running.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query
def stream_chat_requests(spark, folder):
    out = shared_dir(spark, "stream-out")

    def prepare(batch: DataFrame) -> DataFrame:
        typed = batch.select("doc_id", F.col("text").alias("typed"), F.lit("").alias("transcript"))
        resolved = requests.accepted(requests.resolve_requests(typed, "typed", "transcript", trim_typed=False))
        named = resolved.select(F.col("doc_id").alias("request_id"), "resolved")
        return named.join(_vectors(spark, folder, "request_id"), "request_id", "left")

    running = stream_guidance(
        _request_stream(spark, folder, "documents"),
        lambda: _vectors(spark, folder, "doc_id"),
        prepare,
        out,
        shared_dir(spark, "stream-state"),
        key="doc_id",
        name="source",
        text="text",
        query_text="resolved",
        load_records=lambda: table(spark, folder, "documents"),
    )
    running.awaitTermination()
    return context.message_rows(spark.read.parquet(out).drop("batch_id"))


@query
def stream_refresh(spark, folder):
    """Two batches of a lasting stream, with corpus and records refreshed in between."""
    embeddings, documents = table(spark, folder, "embeddings"), table(spark, folder, "documents").select("doc_id", "source")
    corpus, records = (VersionedTable(spark, shared_dir(spark, name)) for name in ("stream-corpus", "stream-records"))
    corpus.write(embeddings.where("label % 2 = 0").withColumnRenamed("vec_id", "doc_id"))
    records.write(documents.withColumn("source", F.concat(F.lit("old "), "source")))
    arriving, out = shared_dir(spark, "stream-in"), shared_dir(spark, "stream-out")
    embeddings.where("vec_id % 2 = 0").write.parquet(arriving)
    running = serve_records(
        spark.readStream.schema(embeddings.schema).parquet(arriving),
        corpus,
        records,
        out,
        shared_dir(spark, "stream-state"),
        key="doc_id",
        query_id="vec_id",
        every="1 second",
    )
    try:
        running.processAllAvailable()
        corpus.write(embeddings.withColumnRenamed("vec_id", "doc_id"))
        records.write(documents)
        embeddings.where("vec_id % 2 = 1").write.mode("append").parquet(arriving)
        running.processAllAvailable()
    finally:
        running.stop()
    found = BatchLog(spark, out).results()
    return found.select("query_id", "rank", "key", "similarity", "source", "corpus_version", "records_version")
