"""Exact top-k inner product by vector approximation.

The corpus is stored in blocks: one column holds quantised cells (one byte a
component), another the exact integers. A first scan reads only the cells and
finds, for each query, a score that k vectors reach for certain. A second scan
bounds every vector by its cells and works through the exact vectors of those
that can still win, best bound first, until the kth score is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.storage import stored

BLOCK_ROWS = 1024
QUERY_ROWS = 512
#: Vectors from which the cells' borders are taken, and bytes of them at most.
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 16 << 20
_LONG = np.iinfo(np.int64)


def _dense(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix for each length of vector in a list column without nulls."""
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        yield rows, values[starts[rows][:, None] + np.arange(length)]


class Cells:
    """Borders of the cells of each component of vectors of one length.

    The inner borders are quantiles of a sample, so that cells are about equally filled whatever the values are like;
    the outer cells end at the least and greatest value of the whole table. ``middle`` and ``half`` give each cell's extent.
    """

    def __init__(self, sample: np.ndarray, low: int, high: int, n_cells: int):
        at = np.arange(1, n_cells) * len(sample) // n_cells
        self.inner = np.sort(sample, axis=0)[at].T.copy()  # component, border: cell c holds values from border c - 1 up to border c
        edge = np.full((len(self.inner), 1), 1, np.int64)
        lows = np.concatenate((edge * low, self.inner), axis=1).astype(np.float64)
        highs = np.concatenate((self.inner, edge * high), axis=1).astype(np.float64)
        self.middle, self.half = (lows + highs) / 2, (highs - lows) / 2

    def number(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(vectors.shape, np.uint8)
        for j, borders in enumerate(self.inner):
            out[:, j] = np.searchsorted(borders, vectors[:, j], side="right")
        return out

    def extents(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.arange(cells.shape[1])
        return self.middle[column, cells], self.half[column, cells]


def _pack(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, matrix in _dense(batch.column(1)):
                for at in range(0, len(rows), BLOCK_ROWS):
                    part = matrix[at : at + BLOCK_ROWS]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "size": [part.shape[1]],
                            "ids": [ids[rows[at : at + BLOCK_ROWS]].astype("<i8").tobytes()],
                            "cells": [_cells_of(sent, part.shape[1]).number(part).tobytes()],
                            "exact": [part.astype("<i8").tobytes()],
                        },
                        schema=_BLOCK,
                    )

    return run


def _cells_of(sent, size: int) -> Cells:
    """Cells of vectors of a length; one that the sample lacks has a single cell a component."""
    cells, low, high = sent.value
    if size not in cells:
        cells[size] = Cells(np.zeros((1, size), np.int64), low, high, 1)
    return cells[size]


_BLOCK = pa.schema([("size", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("exact", pa.binary())])
_BLOCK_DDL = "size int, ids binary, cells binary, exact binary"


class _Wave:
    """A bounded set of queries of one vector length, with the bound k vectors are known to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, low: int, high: int):
        self.ids, self.vectors = ids, vectors
        self.floor = np.full(len(ids), -np.inf)
        # What the sums below may be off by, as doubles round: nothing to speak of unless components are huge.
        size, most = vectors.shape[1], float(max(abs(low), abs(high), 1))
        self.slack = np.abs(vectors.astype(np.float64)).sum(1) * most * (size + 4) * 2.0**-50
        #: Whether scores fit 64 bits; if not they are summed as Python's integers.
        self.fits = most * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * size < 2.0**62

    def floors(self, cells: tuple[np.ndarray, np.ndarray], part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each vector with each query of a slice, by the vector's cells."""
        queries = self.vectors[part].astype(np.float64)
        middle, half = cells[0] @ queries.T, cells[1] @ np.abs(queries).T + self.slack[part]
        return middle - half, middle + half

    def scores(self, exact: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products of vectors with the queries of given numbers; those beyond 64 bits are the nearest long."""
        if self.fits:
            return np.einsum("ij,ij->i", exact, self.vectors[query])
        products = (exact.astype(object) * self.vectors[query].astype(object)).sum(axis=1)
        return np.array([min(max(x, _LONG.min), _LONG.max) for x in products], np.int64)


def _merge(best: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The k greatest of two rows of values, for each query."""
    k = best.shape[1]
    both = np.concatenate((best, new), axis=1)
    return -np.sort(-both, axis=1)[:, :k] if both.shape[1] > k else both


def _lower_bounds(waves, sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: np.full((len(w.ids), k), -np.inf) for size, w in waves.value.items()}
        seen = False
        for batch in batches:
            for size, ids, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (wave := waves.value.get(size)) is None:
                    continue
                seen = True
                ids = np.frombuffer(ids, "<i8")
                cells = _cells_of(sent, size).extents(np.frombuffer(cells, np.uint8).reshape(len(ids), size))
                for at in range(0, len(wave.ids), QUERY_ROWS):
                    part = slice(at, at + QUERY_ROWS)
                    low = wave.floors(cells, part)[0].T
                    low[wave.ids[part][:, None] == ids[None, :]] = -np.inf
                    if low.shape[1] > k:
                        low = -np.partition(-low, k - 1, axis=1)[:, :k]
                    best[size][part] = _merge(best[size][part], low)
        if seen:
            for size, values in best.items():
                for at in range(0, len(values), QUERY_ROWS):
                    yield pa.RecordBatch.from_pydict(
                        {"size": [size], "at": [at], "bounds": [values[at : at + QUERY_ROWS].tobytes()]}, schema=_BOUNDS
                    )

    return run


_BOUNDS = pa.schema([("size", pa.int32()), ("at", pa.int64()), ("bounds", pa.binary())])
_BOUNDS_DDL = "size int, at long, bounds binary"


def _merge_bounds(k: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                new = np.frombuffer(raw).reshape(-1, k)
                best = new if best is None else _merge(best, new)
        yield pa.RecordBatch.from_pydict(
            {"size": [key[0].as_py()], "at": [key[1].as_py()], "bounds": [best.tobytes()]}, schema=_BOUNDS
        )

    return run


def _top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, smaller ids first among equals."""
    order = np.lexsort((ids, -scores, query))
    sorted_query = query[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_query[1:] != sorted_query[:-1])))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))
    return order[rank < k]


def _exact_scores(waves, sent, k: int, step: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {size: [np.zeros(0, np.int64)] * 3 for size in waves.value}
        floors = {size: wave.floor.copy() for size, wave in waves.value.items()}
        for batch in batches:
            for size, ids, cells, exact in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (wave := waves.value.get(size)) is None:
                    continue
                ids = np.frombuffer(ids, "<i8")
                cells = _cells_of(sent, size).extents(np.frombuffer(cells, np.uint8).reshape(len(ids), size))
                exact = np.frombuffer(exact, "<i8").reshape(len(ids), size)
                floor = floors[size]
                for at in range(0, len(wave.ids), QUERY_ROWS):
                    high = wave.floors(cells, slice(at, at + QUERY_ROWS))[1].T
                    query, row = np.nonzero(high >= floor[at : at + QUERY_ROWS, None])
                    bound, query = high[query, row], query + at
                    other = wave.ids[query] != ids[row]
                    order = np.flatnonzero(other)[np.argsort(-bound[other], kind="stable")]
                    query, row, bound = query[order], row[order], bound[order]
                    while len(query):
                        query_now, row_now = query[:step], row[:step]
                        scores = wave.scores(exact[row_now], query_now)
                        old = held[size]
                        new = [np.concatenate(x) for x in zip(old, (query_now, ids[row_now], scores), strict=True)]
                        best = _top(*new, k)
                        held[size] = [x[best] for x in new]
                        kth_query, n = np.unique(held[size][0], return_counts=True)
                        last = np.cumsum(n) - 1
                        full = n == k
                        floor[kth_query[full]] = np.maximum(floor[kth_query[full]], held[size][2][last[full]])
                        query, row, bound = query[step:], row[step:], bound[step:]
                        open_ = bound >= floor[query]
                        query, row, bound = query[open_], row[open_], bound[open_]
        for size, (query, ids, scores) in held.items():
            yield pa.RecordBatch.from_pydict(
                {"query_id": waves.value[size].ids[query], "vec_id": ids, "score": scores}, schema=_HITS
            )

    return run


_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_HITS_DDL = "query_id long, vec_id long, score long"


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    bits: int = 6,
    wave_bytes: int = 32 << 20,
) -> DataFrame:
    """The k greatest inner products of each query with the corpus rows of another id.

    Both tables have ``vec_id long`` and ``vector array<long>``, without nulls. Returns
    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``; ties go to the smaller id. A query
    meets only vectors of its own length; empty vectors take no part. Fewer than k
    other rows: all of them. Repeated rows are separate candidates. An empty table
    gives no rows. Scores are exact whatever the size of the components; a score beyond 64 bits counts
    as the nearest long.

    Queries are taken in waves of about ``wave_bytes`` (each wave's
    size is checked before it is broadcast), and the corpus is scanned in place for
    each wave: it is never shuffled, and only scores that reach the certain bound
    leave a task. A wave's answers are written and its broadcasts freed before the next. ``bits`` (1 to 8) sets the cells a component is quantised to; their
    borders come from at most ``SAMPLE_ROWS`` vectors and ``SAMPLE_BYTES``, which affects how much is pruned, never what is found.
    """
    spark = corpus.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    filled = corpus.where(F.size("vector") > 0).select("vec_id", "vector")
    extent = filled.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector")), F.max(F.size("vector"))).first()
    asked = stored(
        queries.where(F.size("vector") > 0).select("vec_id", "vector").withColumn("row", F.monotonically_increasing_id()), "queries"
    )
    asked_bytes = (asked.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0) * 8
    if extent[0] is None or not asked_bytes:
        return empty
    low, high, longest = extent
    most = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest)))
    sample = filled.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(most).toArrow().combine_chunks().to_batches()
    cells = {m.shape[1]: Cells(m, low, high, 2**bits) for batch in sample for _, m in _dense(batch.column(0))}
    borders = spark.sparkContext.broadcast((cells, low, high))
    blocks = stored(filled.mapInArrow(_pack(borders), _BLOCK_DDL), "vafile")
    n_waves = -(-asked_bytes // (wave_bytes // 2))
    found = []
    for number in range(n_waves):
        wave = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_waves)) == number).select("vec_id", "vector")
        table = _collect_bounded(wave, wave_bytes, 8 * longest)
        own = {
            int(matrix.shape[1]): _Wave(table.column(0).to_numpy()[rows], matrix, low, high)
            for rows, matrix in _dense(table.column(1))
        }
        if not own:
            continue
        sent = spark.sparkContext.broadcast(own)
        partial = blocks.select("size", "ids", "cells").mapInArrow(_lower_bounds(sent, borders, k), _BOUNDS_DDL)
        for size, at, raw in partial.groupBy("size", "at").applyInArrow(_merge_bounds(k), _BOUNDS_DDL).collect():
            own[size].floor[at : at + len(raw) // (8 * k)] = np.frombuffer(raw).reshape(-1, k)[:, k - 1]
        bounded = spark.sparkContext.broadcast(own)
        found.append(stored(blocks.mapInArrow(_exact_scores(bounded, borders, k), _HITS_DDL), "hits"))
        sent.destroy()
        bounded.destroy()
    if not found:
        return empty
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order).cast(T.IntegerType()))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _collect_bounded(wave: DataFrame, most: int, one: int) -> pa.RecordBatch:
    """A wave's rows at the driver, after its size has been checked; a single query of any size may pass."""
    size = wave.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    if 8 * size > most + one:
        raise ValueError(f"a wave of queries holds {8 * size} bytes, more than {most}")
    return wave.toArrow().combine_chunks().to_batches(max_chunksize=None)[0] if size else _NO_QUERIES


_NO_QUERIES = pa.RecordBatch.from_pydict(
    {"vec_id": [], "vector": []}, schema=pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.int64()))])
)
