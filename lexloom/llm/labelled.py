"""Labelled rows to fit classifiers on, and sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 64


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int
) -> DataFrame:
    """At most ``most`` labelled documents outside the held-out fold: ``doc_id``, ``text``, ``label``, ``text_hash``.

    Labels other than 0 and 1 are left out; of contradicting labels of a document the smaller counts.
    The documents are those whose keys have the smallest hashes, so the choice does not depend on
    order or partitioning. ``most`` keys are small enough to broadcast.
    """
    usable = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    one = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "text", "label", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def one_per_document(made: DataFrame) -> DataFrame:
    """Of rows that share a ``doc_id``, the one whose text has the least ``text_hash``."""
    others = [name for name in made.columns if name not in ("doc_id", "text_hash")]
    least = made.groupBy("doc_id").agg(F.min_by(F.struct(*others), "text_hash").alias("one"))
    return least.select("doc_id", "one.*")


def summed(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, parts: int = 32) -> np.ndarray:
    """Sum of the int64 arrays of one fixed length that ``add`` makes of the rows of each task.

    Each array is sent in ``parts`` pieces, which are added up first by task number modulo ``LANES``,
    then over those lanes. Only the result, of a length fixed beforehand, reaches the driver.
    """
    step = -(-length // parts)
    schema = pa.schema([("part", pa.int32()), ("lane", pa.int32()), ("sums", pa.binary())])
    ddl = "part int, lane int, sums binary"

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(add(batches), np.int64)
        lane = TaskContext.get().partitionId() % LANES
        if total.any():
            for part in range(parts):
                piece = total[part * step : (part + 1) * step]
                yield pa.RecordBatch.from_pydict({"part": [part], "lane": [lane], "sums": [_narrow(piece)]}, schema=schema)

    def together(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                total = _wide(raw) if total is None else total + _wide(raw)
        lane = key[1].as_py() if len(key) > 1 else 0
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "lane": [lane], "sums": [_narrow(total)]}, schema=schema)

    lanes = rows.mapInArrow(in_task, ddl).groupBy("part", "lane").applyInArrow(together, ddl)
    found = {r["part"]: _wide(r["sums"]) for r in lanes.groupBy("part").applyInArrow(together, ddl).collect()}
    return np.concatenate([found[p] for p in range(parts)]) if found else np.zeros(length, np.int64)


def _narrow(values: np.ndarray) -> bytes:
    small = len(values) == 0 or (np.abs(values).max() < 2**31)
    return (b"4" if small else b"8") + values.astype("<i4" if small else "<i8").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if raw[:1] == b"4" else "<i8", offset=1).astype(np.int64)
