"""Quoted CSV read by many tasks: where records begin is found by a prefix computation over byte ranges.

A line break ends a record only outside quotes, and whether a byte range begins inside quotes depends on all that
stands before it. Each range is therefore read twice. The first pass finds what the range does to either state: outside
quotes it ends in one state, inside quotes in another. These small results are combined along each file, which gives the
state every range begins in. The second pass cuts records in place; only records that cross the border of a range
leave their task, as fragments that are put together by file and place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.sources.csv import NO_TEXT

_QUOTED = re.compile(r'(?:[^"]|"")*')

#: What a fragment of a record is: all of it, its first lines, lines from its middle, its last lines.
WHOLE, FIRST, MIDDLE, LAST = range(4)


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether the text after ``line`` is inside quotes. A quote opens only at the start of a field."""
    place = 0
    while True:
        if inside:
            place = _QUOTED.match(line, place).end()
            if place >= len(line):
                return True
            inside, place = False, place + 1
        elif line.startswith('"', place):
            inside, place = True, place + 1
            continue
        place = line.find(delimiter, place)
        if place < 0:
            return False
        place += len(delimiter)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], np.ndarray]]:
    """Lines of one byte range at a time: file, first byte, lines, numbers of the lines that hold quotes."""
    for batch in batches:
        file, start = batch.column("file"), np.asarray(batch.column("start"))
        named = file.dictionary_encode()
        codes = np.asarray(named.indices)
        cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(codes) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a < b:
                lines = batch.column("value").slice(a, b - a)
                quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
                yield named.dictionary[codes[a]].as_py(), int(start[a]), lines.to_pylist(), quoted


def _effects(delimiter: str):
    """State after each range if it begins outside quotes, and if it begins inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, [False, True]
        out = []
        for file, start, lines, quoted in _runs(batches):
            if (file, start) != at:
                if at:
                    out.append((*at, *ends))
                at, ends = (file, start), [False, True]
            for i in quoted:
                ends = [ends_inside(lines[i], state, delimiter) for state in ends]
        if at:
            out.append((*at, *ends))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "from_outside", "from_inside"]
        )

    return run


def starting_states(effects: DataFrame) -> DataFrame:
    """``(file, start, inside)``: whether each range begins inside quotes.

    A range either ends in one state whatever it began in, keeps the state, or turns it round. The state is what
    the last range of the first kind left, turned by those between.
    """
    in_file = Window.partitionBy("file").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("from_outside") == F.col("from_inside")
    turns = F.col("from_outside") & ~F.col("from_inside")
    counted = effects.withColumn("turned", F.sum(turns.cast("int")).over(in_file))
    left = F.when(settles, F.struct((F.col("from_outside").cast("int") - F.col("turned")).alias("base")))
    base = F.coalesce(F.last(left, ignorenulls=True).over(before)["base"], F.lit(0))
    turned = F.coalesce(F.last("turned").over(before), F.lit(0))
    return counted.select("file", "start", (F.pmod(base + turned, F.lit(2)) == 1).alias("inside"))


def _cut(inside_starts: dict[str, frozenset[int]], delimiter: str):
    """Records and fragments of each range: ``file, start, piece, kind, head, record``.

    ``head`` marks what begins a file. A fragment carries its line break.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, kind, head, held, out = None, False, WHOLE, False, [], []

        def close():
            if held:
                out.append((*at, len(out), {WHOLE: FIRST, LAST: MIDDLE}[kind], head, "\n".join(held) + "\n"))

        def emitted():
            columns = list(zip(*out, strict=True))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            names = ["file", "start", "piece", "kind", "head", "record"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for file, start, lines, quoted in _runs(batches):
            if (file, start) != at:
                if at:
                    close()
                at, held = (file, start), []
                inside = start in inside_starts.get(file, ())
                kind, head = (LAST if inside else WHOLE), start == 0
            marked = set(quoted.tolist())
            for i, line in enumerate(lines):
                held.append(line)
                if i in marked:
                    inside = ends_inside(line, inside, delimiter)
                if not inside:
                    out.append((*at, len(out), kind, head, "\n".join(held)))
                    held, kind, head = [], WHOLE, False
            if out:
                yield emitted()
                out.clear()
        if at:
            close()
            if out:
                yield emitted()

    return run


def split_records(spark: SparkSession, path, delimiter: str = ",") -> DataFrame:
    """``(record, head)``: the text of every record of quoted CSV files; ``head`` marks the first of each file.

    Ranges are those in which Spark splits the files (``spark.sql.files.maxPartitionBytes``). Their states are collected:
    one number a range that begins inside quotes, so a few bytes for each range of input.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    effects = lines.mapInArrow(_effects(delimiter), "file string, start long, from_outside boolean, from_inside boolean")
    states = starting_states(effects).where("inside").groupBy("file").agg(F.collect_list("start").alias("starts"))
    inside_starts = {r["file"]: frozenset(r["starts"]) for r in states.collect()}
    pieces = lines.mapInArrow(
        _cut(inside_starts, delimiter), "file string, start long, piece long, kind int, head boolean, record string"
    )
    whole = pieces.where(F.col("kind") == WHOLE).select("record", "head")
    parts = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == FIRST)
    numbered = parts.withColumn("number", F.sum((F.col("kind") == FIRST).cast("int")).over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"])
    joined = numbered.groupBy("file", "number").agg(F.array_join(texts, "").alias("record"), F.max("head").alias("head"))
    return whole.unionByName(joined.select("record", "head"))


def read_quoted_csv_in_parts(
    spark: SparkSession, path, schema: T.StructType | None = None, delimiter: str = ",", split_bytes: int | None = None
) -> DataFrame:
    """As :func:`lexloom.sources.csv.read_quoted_csv`, with each file read by as many tasks as it has ranges.

    Use it for files larger than one task should read. Each file is read twice, and its lines pass through Python.
    Line breaks inside quotes keep their bytes.
    ``split_bytes`` sets the size of a range for this read alone.
    """
    if split_bytes:
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    options = {"quote": '"', "escape": '"', "sep": delimiter, "nullValue": NO_TEXT, "emptyValue": ""}
    if schema is None:
        reader = spark.read.option("header", True).option("multiLine", True)
        for name, value in options.items():
            reader = reader.option(name, value)
        schema = reader.csv(path).schema
    records = split_records(spark, path, delimiter).where(~F.col("head")).select(F.rtrim("record", F.lit("\r\n")).alias("record"))
    parsed = F.from_csv("record", schema.simpleString(), {**options, "multiLine": "true"})
    return records.where(F.col("record") != "").select(parsed.alias("row")).select("row.*")
