"""Line dedup on content-defined chunks of lines, with DataFrame functions only.

A text is a row of elements: its filled lines, and each stretch of blank lines between them as one. A rolling hash over the hashes of
two neighbouring elements goes along the text. Where that hash stands nowhere else in the table, or first stood in another
place than its neighbour's did, is a boundary. What lies between two boundaries is a chunk: it depends on its own lines alone, so a passage
gives the same chunks wherever it stands, and a chunk is as long as its first occurrence goes along with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.storage import stored

FILLED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it stands in the expression."""
    return F.transform(F.array(value), use)[0]


def _element_starts(lines: Column) -> Column:
    """Places of the first lines of elements: filled lines, and blank ones that follow no blank line."""
    return _bound(
        F.transform(lines, lambda line: F.rlike(line, F.lit(FILLED))),
        lambda filled: F.filter(
            F.sequence(F.lit(0), F.size(filled) - 1),
            lambda i: F.get(filled, i) | (i == 0) | F.get(filled, F.greatest(i - 1, F.lit(0))),
        ),
    )


def _rolled(texts: DataFrame) -> DataFrame:
    """``(key, hash, at, first, lines, rolled)``: every two neighbouring elements, with the hash of both.

    ``at`` counts elements, ``first`` lines. No two blank stretches are neighbours, so one of the elements holds a word.
    """

    def pairs(starts: Column, ends: Column, hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(starts) - 2),
            lambda i: F.struct(
                i.alias("at"),
                F.get(starts, i).alias("first"),
                (F.get(ends, i + 1) - F.get(starts, i)).alias("lines"),
                F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)).alias("rolled"),
            ),
        )

    def of_starts(lines: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
        hashes = lambda ends: F.zip_with(starts, ends, lambda a, b: F.xxhash64(F.slice(lines, a + 1, b - a)))
        made = _bound(ends, lambda ends: _bound(hashes(ends), lambda hashes: pairs(starts, ends, hashes)))
        none = F.array().cast("array<struct<at:int,first:int,lines:int,rolled:bigint>>")
        return F.when(F.size(starts) > 1, made).otherwise(none)

    found = _bound(_lines(F.col("text")), lambda lines: _bound(_element_starts(lines), lambda starts: of_starts(lines, starts)))
    return texts.where(F.contains("text", F.lit("\n"))).select("key", "hash", F.inline(found))


def _repeated_chunks(rolled: DataFrame) -> DataFrame:
    """``(key, hash, first, stop, of_key, of_hash, of_first, of_stop)``: chunks (lines from ``first`` up to ``stop``) and where they first stood.

    The first place of a hash is the least by key, text and place. Places that overlap it are no repeats of it.
    """
    least = F.min(F.struct("key", "hash", "at", "first")).alias("of")
    earliest = rolled.groupBy("rolled", "lines").agg(least, F.count("*").alias("n")).where("n > 1")
    earliest = stored(earliest.select("rolled", "lines", *[F.col(f"of.{c}").alias(f"of_{c}") for c in ("key", "hash", "at", "first")]), "earliest")
    met = rolled.join(earliest.hint("merge"), ["rolled", "lines"])
    one_text = F.col("key").eqNullSafe(F.col("of_key")) & (F.col("hash") == F.col("of_hash"))
    later = met.where(~one_text | (F.col("first") >= F.col("of_first") + F.col("lines")))
    along = later.withColumn("shift", F.col("at") - F.col("of_at"))
    in_step = Window.partitionBy("key", "hash", "of_key", "of_hash", "shift").orderBy("at")
    along = along.withColumn("chunk", F.col("at") - F.dense_rank().over(in_step))
    return along.groupBy("key", "hash", "of_key", "of_hash", "shift", "chunk").agg(
        F.min("first").alias("first"),
        F.max(F.col("first") + F.col("lines")).alias("stop"),
        F.min("of_first").alias("of_first"),
        F.max(F.col("of_first") + F.col("lines")).alias("of_stop"),
    )


def _bodies(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(key, hash, first, stop, body)`` of every chunk and of every place that a chunk first stood in, once each."""
    places = chunks.select("key", "hash", "first", "stop")
    places = places.union(chunks.select("of_key", "of_hash", "of_first", "of_stop")).distinct()
    wanted = places.groupBy(F.col("key").alias("k"), F.col("hash").alias("h")).agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    met = texts.join(stored(wanted, "spans").hint("merge"), _same("key", "hash", "k", "h"))
    body = lambda lines, s: F.array_join(F.slice(lines, s["first"] + 1, s["stop"] - s["first"]), "\n")
    cut = _bound(
        _lines(F.col("text")),
        lambda lines: F.transform(
            "spans", lambda s: F.struct(s["first"].alias("first"), s["stop"].alias("stop"), body(lines, s).alias("body"))
        ),
    )
    # rows with equal key and text give equal bodies, of which one is kept
    return met.select("key", "hash", F.inline(cut)).groupBy("key", "hash", "first", "stop").agg(F.min("body").alias("body"))


def line_dedup(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove the chunks of two lines or more that occurred before anywhere in the table.

    A line goes if it is in a run of at least two elements (filled lines, and stretches of blank lines, each taken whole) whose
    bytes stand in an earlier place that they do not overlap, in the order of key and place. So repeated passages go whole,
    whatever stands around them, and their first occurrence stays; single lines stay. A removed line always stands in
    an earlier place, and of each line one copy stays. Chunks are compared byte by byte with the place they first stood in.

    Returns the input's columns with the text that is left, and ``lines_removed`` (long; a column of that name is replaced). A text without a
    removed line keeps its bytes. A null text stays null; an empty one and one of blank lines alone stay. Null keys come first in order. Rows with equal key and text
    count as one document and get the same result. An empty table gives no rows. Names of other columns do not matter.

    Only hashes and places are shuffled to find repeats: work and size are in proportion to the lines, blank or not. The bytes of repeated chunks
    follow, each once, then each text meets its removed ranges. A frequent chunk is joined to the one row
    of its first place, which the adaptive skew join can split. What repeats has no bound, so none of it is
    broadcast.
    """
    columns = [name for name in documents.columns if name != "lines_removed"]
    body = F.col(f"`{text}`")
    held = documents.select(
        F.struct(*[F.col(f"`{name}`") for name in columns if name != text]).alias("row"),
        F.col(f"`{key}`").alias("key"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("hash"),
        body.alias("text"),
    )
    texts = held.select("key", "hash", "text")
    chunks = stored(_repeated_chunks(stored(_rolled(texts), "rolled")), "chunks")
    bodies = stored(_bodies(texts, chunks), "bodies")

    def named(side: str) -> DataFrame:
        return bodies.select(*[F.col(c).alias(f"{side}_{c}") for c in bodies.columns])

    place = lambda side: _same("key", "hash", f"{side}_key", f"{side}_hash") & (F.col("first") == F.col(f"{side}_first")) & (F.col("stop") == F.col(f"{side}_stop"))
    own = chunks.join(named("own").hint("merge"), place("own")).select(*[f"of_{c}" for c in ("key", "hash", "first", "stop")], "key", "hash", "first", "stop", "own_body")
    was = bodies.select(*[F.col(c).alias(f"was_{c}") for c in bodies.columns]).hint("merge")
    there = (
        _same("of_key", "of_hash", "was_key", "was_hash")
        & (F.col("of_first") == F.col("was_first"))
        & (F.col("of_stop") == F.col("was_stop"))
    )
    doomed = own.join(was, there).where(F.col("own_body") == F.col("was_body"))
    ranges = doomed.groupBy(F.col("key").alias("k"), F.col("hash").alias("h")).agg(
        F.collect_set(F.struct("first", "stop")).alias("ranges")
    )
    joined = held.join(stored(ranges, "ranges").hint("merge"), _same("key", "hash", "k", "h"), "left")
    hit = F.col("ranges").isNotNull()
    gone = F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["stop"] - 1)))

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        stay = lambda at: F.struct(
            F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(at)).alias("removed")
        )
        return _bound(places, stay)

    done = joined.select("row", "text", F.when(hit, _bound(_lines(F.col("text")), left)).alias("left"))
    changed = F.when(F.col("left").isNotNull(), F.col("left.text")).otherwise(F.col("text"))
    values = [changed.alias(name) if name == text else F.col(f"row.`{name}`") for name in columns]
    return done.select(*values, F.coalesce("left.removed", F.lit(0)).cast("long").alias("lines_removed"))


def _same(key: str, hash_: str, other_key: str, other_hash: str) -> Column:
    return F.col(key).eqNullSafe(F.col(other_key)) & (F.col(hash_) == F.col(other_hash))
