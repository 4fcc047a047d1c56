"""From a section table to a searchable embedding table, in one go or by what has changed."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import embedding_text
from lexloom.operators.embed import Encoder, embed_texts
from lexloom.session import written
from lexloom.sources.vectors import check_dimensions, vector_metrics, write_embedding_table
from lexloom.sources.versions import VersionedTable

#: Columns that an updatable index keeps beside those of the sections.
TEXT_HASH, ROW_HASH, BUCKET = "__text_hash", "__row_hash", "__bucket"


def build_index(
    sections: DataFrame,
    path: str,
    load_model: Callable[[], Encoder],
    name: str = "Section_name",
    body: str = "Description",
    batch_size: int = 64,
) -> dict:
    """Embed ``name. body`` of every row and store vectors beside the rows; returns the counts."""
    texts = sections.withColumn("embedding_text", embedding_text(F.col(name), F.col(body)))
    vectors = embed_texts(texts, "embedding_text", load_model, batch_size)
    return write_embedding_table(vectors.drop("embedding_text"), path)


def update_index(
    sections: DataFrame,
    path: str,
    load_model: Callable[[], Encoder],
    key: str,
    name: str = "Section_name",
    body: str = "Description",
    batch_size: int = 64,
    buckets: int = 64,
) -> dict:
    """Bring the embedding table at ``path`` up to date with ``sections``; the first call builds it.

    Rows are told apart by ``key``, unique and not NULL (rows without one are left out). A row whose embedding text has the hash it
    had keeps its vector, wherever else it changed: only rows that are new or whose text changed meet the model. Rows lie in
    ``buckets`` by key. Only buckets with a difference are written again; the next version takes the others' files as they are.
    Returns the counts ``new``, ``changed`` (text), ``edited`` (other columns), ``gone``, ``same``, ``embedded`` and ``buckets`` rewritten.
    """
    table = VersionedTable(sections.sparkSession, path)
    columns = sections.columns
    fresh = sections.where(F.col(key).isNotNull()).withColumns(
        {
            TEXT_HASH: F.sha2(embedding_text(F.col(name), F.col(body)), 256),
            ROW_HASH: F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256),
            BUCKET: F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"),
        }
    )
    based_on = table.current()
    if based_on is None:
        rows = embed_texts(fresh.withColumn("__text", embedding_text(F.col(name), F.col(body))), "__text", load_model, batch_size)
        rows = rows.drop("__text").repartition(F.col(BUCKET))
        made = table.write(rows, (BUCKET,), {"buckets": str(buckets)}, vector_metrics("embedding"), check_dimensions)
        n = made.figures["rows"]
        touched = fresh.select(BUCKET).distinct().count()
        return {"new": n, "changed": 0, "edited": 0, "gone": 0, "same": 0, "embedded": n, "buckets": touched}

    version = table.version(based_on)
    if version.properties.get("buckets") != str(buckets):
        raise ValueError(f"the table has {version.properties.get('buckets')} buckets")
    held = table.read(based_on)
    now = fresh.select(key, F.col(TEXT_HASH).alias("text_now"), F.col(ROW_HASH).alias("row_now"), F.col(BUCKET).alias("bucket_now"))
    state = (
        F.when(F.col(TEXT_HASH).isNull(), "new")
        .when(F.col("text_now").isNull(), "gone")
        .when(F.col(TEXT_HASH) != F.col("text_now"), "changed")
        .when(F.col(ROW_HASH) != F.col("row_now"), "edited")
        .otherwise("same")
    )
    compared = held.select(key, TEXT_HASH, ROW_HASH, BUCKET).join(now, key, "full")
    bucket = F.coalesce(F.col(BUCKET), F.col("bucket_now")).alias("bucket")
    by_bucket = compared.select(state.alias("state"), bucket).groupBy("bucket", "state").count().collect()  # five rows a bucket
    counts = {s: sum(r["count"] for r in by_bucket if r["state"] == s) for s in ("new", "changed", "edited", "gone", "same")}
    touched = sorted({r["bucket"] for r in by_bucket if r["state"] != "same"})
    figures = {**counts, "embedded": counts["new"] + counts["changed"], "buckets": len(touched)}
    if not touched:
        return figures

    wanted = written(fresh.where(F.col(BUCKET).isin(touched)), "index-rows")
    vectors = held.where(F.col(BUCKET).isin(touched)).select(key, TEXT_HASH, "embedding", F.lit(True).alias("__held"))
    joined = wanted.join(vectors, [key, TEXT_HASH], "left")
    kept = joined.where("__held").drop("__held")
    asked = wanted.join(vectors, [key, TEXT_HASH], "left_anti").withColumn("__text", embedding_text(F.col(name), F.col(body)))
    made = embed_texts(asked, "__text", load_model, batch_size).drop("__text")
    order = version.struct.fieldNames()
    if set(order) != set(kept.columns):
        raise ValueError("the sections' columns are not those of the table: build it anew")
    rows = kept.select(*order).unionByName(made.select(*order)).repartition(F.col(BUCKET))
    segment, seen = table.stage(rows, (BUCKET,), vector_metrics("embedding"))
    check_dimensions(seen)
    if seen["stored"] and version.figures["dimension"] not in (None, -1, seen["dimension"]):
        raise ValueError(f"vectors of {seen['dimension']} elements for a table of {version.figures['dimension']}")
    in_touched = tuple(f"{BUCKET}={number}/" for number in touched)
    others = table.without(version, lambda file: file.startswith(in_touched))
    schema = json.loads(rows.select(*order).schema.json())
    table.commit(replace(version, schema=schema, segments=(*others, segment), figures={**version.figures, **seen}), based_on)
    return figures
