"""Mixing sources to target weights: repetition rates per source, hash-seeded copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.storage import free_name

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3
) -> DataFrame:
    """Target size of each source.

    ``sizes`` has one row per source with ``source`` and ``source_size``. Sources in
    code-point order, null last, take ``weights`` in turn and share the sum of all
    sizes by weight; no target exceeds ``max_rate`` times its source's size, and
    what such sources leave is shared again among the others by weight until none
    exceeds its limit.

    A source reaches its limit once the common level (target per unit of weight)
    passes ``max_rate * source_size / weight``. Sources are therefore sorted by that
    ratio: a prefix of them is at its limit, the rest share what is left. Sources
    of size 0 have target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    limit = F.col("source_size") * max_rate
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight"), limit.alias("limit"))
    level = F.col("limit") / F.col("weight")
    before = Window.orderBy(level, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    # a source is at its limit when its share of what the sources before it leave reaches the limit
    wide = lambda name: F.col(name).cast("decimal(19,0)")  # noqa: E731  products of two may pass 64 bits
    full = wide("limit") * wide("left_weight") <= wide("weight") * wide("left")
    rows = rows.withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(whole), F.lit(0))
    rest = F.sum("source_size").over(whole) - taken
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    shared = (F.col("weight") * rest).cast("double") / rest_weight
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared)
    return rows.select("source", "source_size", target.alias("target"))


def unit_draw(key: Column, seed: int) -> Column:
    """A number from [0, 1) that only the key and the seed decide."""
    digest = F.md5(F.concat_ws("\u0001", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("\u0000"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix_sources(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_rate: int = 3,
    seed: int = 7,
) -> DataFrame:
    """Give every document its number of copies in the mix.

    Adds ``mix_size`` (words), ``mix_source_size``, ``mix_target`` (the source's) and ``mix_copies``:
    floor(rate) plus one more if the draw of the key falls below the fraction, where
    rate is target / source size. Rates do not exceed ``max_rate``, so no document
    does. Reruns give the same copies.

    Null text: size 0. Null key: one key like any other. A source of size 0 has rate
    1 (its documents hold no words and stay as they are). Repeated rows: each is
    drawn by its key and text, so equal rows get equal copies. Empty table: no rows.
    Columns named like the added ones are replaced.

    Sizes are summed per source before anything is shuffled; the table of sources is
    joined back on the source, where a hot source is only ever streamed past its one
    row: its partition splits under the adaptive skew join.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    draw = unit_draw(F.concat_ws("\u0002", F.col(key), digest), seed)
    names = {name: free_name(documents, name) for name in ("source", "source_size", "target", "draw")}
    sized = documents.withColumns({"mix_size": word_count(F.col(text)), names["draw"]: draw})
    sources = sized.groupBy(F.col(source).alias("source")).agg(F.sum("mix_size").alias("source_size"))
    targets = source_targets(sources, weights, max_rate).select(
        *[F.col(name).alias(names[name]) for name in ("source", "source_size", "target")]
    )
    joined = sized.join(targets, sized[source].eqNullSafe(targets[names["source"]]))
    source_size, target = F.col(names["source_size"]), F.col(names["target"])
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    copies = whole + F.when(F.col(names["draw"]) < rate - whole, F.lit(1)).otherwise(F.lit(0))
    return joined.withColumns(
        {"mix_source_size": source_size, "mix_target": target, "mix_copies": copies.cast("long")}
    ).drop(*names.values())


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy of each document, without the columns that ``mix_sources`` added."""
    repeated = mixed.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int"))))
    return repeated.drop("mix_copy", "mix_size", "mix_source_size", "mix_target", "mix_copies")
