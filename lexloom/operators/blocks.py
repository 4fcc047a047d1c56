"""Exact top-k search as block products inside Spark tasks.

Every query must meet every corpus row, but no pair ever becomes a Spark row:
tasks score whole blocks with numpy and emit at most k rows per query. How the
sides meet depends on their measured sizes:

``queries``  the query side is small: it is broadcast, the corpus streams past it
             in place, and the per-task top-k rows are merged by query;
``corpus``   the corpus is small: it is broadcast and each query is finished in
             its own task, without any shuffle;
``waves``    both are large: the smaller side is cut into slices of bounded size that are
             broadcast one after the other, and the larger side is read in place for
             each; it is never shuffled. Where that takes more than ``Limits.most_waves``
             slices, one shuffle brings the sides together instead: each task holds a
             share of one side of bounded size and the rows of the other stream past it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.session import FULL_SPLIT, written

TILE_ROWS = 2048


@dataclass(frozen=True)
class Limits:
    """Sizes beyond which a side, or a slice of it, is not broadcast."""

    broadcast_bytes: int = 128 << 20
    partial_rows: int = 4_000_000
    pairs_per_task: int = 50_000_000
    most_waves: int = 16
    share_bytes: int = 32 << 20


@dataclass(frozen=True)
class Side:
    """One side of a search.

    ``rows`` holds the key and the vector columns. ``source`` has at least as
    many rows and is cheap to count. ``bytes_for`` bounds the size of ``rows``
    given that count, without computing all vectors.
    """

    rows: DataFrame
    key: str
    source: DataFrame
    bytes_for: Callable[[int], int]

    def count(self) -> int:
        return self.source.count()

    @property
    def key_type(self) -> T.DataType:
        return self.rows.schema[self.key].dataType


@dataclass(frozen=True)
class Matches:
    """``(query_id, rank, key, similarity)`` and a bound on the number of its rows."""

    rows: DataFrame
    at_most: int


class DenseKernel:
    """Inner products of equally long ``vector`` columns."""

    columns = ("vector",)
    first_look = 256

    def load(self, table: pa.Table) -> np.ndarray:
        column = table.column("vector").combine_chunks()
        lengths = pc.unique(pc.list_value_length(column))
        if len(lengths) > 1:
            raise ValueError(f"vectors of different lengths: {sorted(lengths.to_pylist())}")
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if not np.isfinite(flat).all():
            raise ValueError("vectors hold NaN or infinite elements")
        return flat.reshape(len(column), -1)

    def score(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if left.shape[1] != right.shape[1]:
            raise ValueError(f"vectors of {left.shape[1]} and {right.shape[1]} elements cannot be compared")
        return left.astype(np.float64) @ right.astype(np.float64).T

    def best(
        self, left: np.ndarray, right: np.ndarray, k: int, decimals: int, floor: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :func:`best_cells` of the scores, which are computed in double precision only where they can matter.

        Products in single precision are off by at most ``slack``: a cell whose product stays below the floor by more is not among
        the best. Before a row has a floor, the kth best of its first cells gives one.
        """
        if left.shape[1] != right.shape[1]:
            raise ValueError(f"vectors of {left.shape[1]} and {right.shape[1]} elements cannot be compared")
        if left.dtype != np.float32 or right.dtype != np.float32:
            return best_cells(self.score(left, right), k, decimals, floor)
        lengths = np.sqrt(np.einsum("ij,ij->i", left, left, dtype=np.float64))
        longest = np.sqrt(np.einsum("ij,ij->i", right, right, dtype=np.float64)).max(initial=0.0)
        if lengths.max(initial=0.0) * longest > 1e30:
            return best_cells(self.score(left, right), k, decimals, floor)
        slack = (left.shape[1] + 8) * 2.0**-22 * lengths * longest + 1e-30
        rough = left @ right.T
        look = rough[:, : max(self.first_look, 4 * k)]
        if look.shape[1] >= k and np.isneginf(floor).any():
            place = look.shape[1] - k
            floor = np.maximum(floor, np.partition(look, place, axis=1)[:, place] - slack - 10.0**-decimals)
        least = (floor - 10.0**-decimals - slack).astype(np.float32)
        cells = _true_cells(rough >= np.nextafter(least, np.float32(-np.inf))[:, None])
        if len(cells) > rough.size // 16:
            return best_cells(self.score(left, right), k, decimals, floor)
        rows, columns = np.divmod(cells, rough.shape[1])
        scores = np.einsum("ij,ij->i", left[rows], right[columns], dtype=np.float64)
        return best_of_cells(rows, columns, scores, k, decimals, floor)


class SparseKernel:
    """Inner products of ``terms``/``weights`` columns; rows without a common term never match."""

    columns = ("terms", "weights")
    products_at_once = 4_000_000
    terms_at_once = 512

    def load(self, table: pa.Table) -> dict:
        """Posting lists of the rows, one list per term."""
        terms = table.column("terms").combine_chunks()
        lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        coded = terms.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        by_term = np.argsort(codes, kind="stable")
        weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return {
            "n": len(terms),
            "vocabulary": coded.dictionary,
            "starts": np.searchsorted(codes[by_term], np.arange(len(coded.dictionary) + 1)),
            "rows": np.repeat(np.arange(len(terms)), lengths.astype(np.int64))[by_term],
            "weights": weights[by_term],
        }

    def score(self, left: dict, right: dict) -> np.ndarray:
        """Sum over common terms: as matrices for frequent terms, entry by entry for rare ones."""
        found = pc.index_in(right["vocabulary"], value_set=left["vocabulary"])
        in_right = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        in_left = found.drop_null().to_numpy(zero_copy_only=False)
        n_products = self._lengths(left, in_left) * self._lengths(right, in_right)
        frequent = n_products * 100 > left["n"] * right["n"]

        dots = np.zeros((left["n"], right["n"]))
        some, others = in_left[frequent], in_right[frequent]
        for start in range(0, len(some), self.terms_at_once):
            part = slice(start, start + self.terms_at_once)
            dots += self._matrix(left, some[part]) @ self._matrix(right, others[part]).T

        some, others, n_products = in_left[~frequent], in_right[~frequent], n_products[~frequent]
        cells = dots.ravel()
        part_of = np.cumsum(n_products) // self.products_at_once
        for part in np.unique(part_of):
            at_left, at_right = self._pairs(left, right, some[part_of == part], others[part_of == part])
            cell = left["rows"][at_left] * right["n"] + right["rows"][at_right]
            cells += np.bincount(cell, left["weights"][at_left] * right["weights"][at_right], len(cells))
        dots[dots == 0.0] = -np.inf
        return dots

    def best(self, left: dict, right: dict, k: int, decimals: int, floor: np.ndarray):
        return best_cells(self.score(left, right), k, decimals, floor)

    @staticmethod
    def _lengths(side: dict, terms: np.ndarray) -> np.ndarray:
        return side["starts"][terms + 1] - side["starts"][terms]

    def _matrix(self, side: dict, terms: np.ndarray) -> np.ndarray:
        lengths = self._lengths(side, terms)
        column = np.repeat(np.arange(len(terms)), lengths)
        first = np.repeat(side["starts"][terms] - (np.cumsum(lengths) - lengths), lengths)
        entry = first + np.arange(len(column))
        matrix = np.zeros((side["n"], len(terms)))
        matrix[side["rows"][entry], column] = side["weights"][entry]
        return matrix

    def _pairs(self, left: dict, right: dict, in_left: np.ndarray, in_right: np.ndarray):
        """Entry positions of every product of the given terms' posting lists."""
        n_right = self._lengths(right, in_right)
        n_products = self._lengths(left, in_left) * n_right
        term = np.repeat(np.arange(len(in_left)), n_products)
        nth = np.arange(len(term)) - np.repeat(np.cumsum(n_products) - n_products, n_products)
        at_left = left["starts"][in_left[term]] + nth // n_right[term]
        at_right = right["starts"][in_right[term]] + nth % n_right[term]
        return at_left, at_right


def _tiles(tables: Iterable[pa.Table], key: str) -> Iterator[pa.Table]:
    """Slices of bounded height, each in key order so that ties resolve by position."""
    for table in tables:
        for start in range(0, table.num_rows, TILE_ROWS):
            piece = table.slice(start, TILE_ROWS)
            yield piece.take(pc.sort_indices(piece.column(key)))


def best_cells(
    scores: np.ndarray, k: int, decimals: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and rounded values of the k best finite scores of each row.

    Equal scores favour the earlier column. ``floor`` is a value per row below
    which nothing is wanted; only rows in which more than k scores pass it are
    searched for their k-th value.
    """
    lowest = np.finfo(np.float64).min
    least = lowest if floor is None else np.maximum(floor - 10.0**-decimals, lowest)[:, None]
    keep = scores >= least
    crowded = np.flatnonzero(np.count_nonzero(keep, axis=1) > k)
    if len(crowded):
        rivals = np.round(np.where(keep[crowded], scores[crowded], -np.inf), decimals)
        place = rivals.shape[1] - k
        kth = np.partition(rivals, place, axis=1)[:, place, None]
        above, level = rivals > kth, rivals == kth
        room = k - above.sum(axis=1, keepdims=True)
        keep[crowded] = above | (level & (np.cumsum(level, axis=1) <= room))
    rows, columns = np.nonzero(keep)
    return rows, columns, np.round(scores[rows, columns], decimals)


def _true_cells(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true cells; eight at a time are passed over where none is."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    near = np.concatenate([near, np.arange(whole, len(flat))])
    return near[flat[near]]


def best_of_cells(
    rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int, decimals: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`best_cells`, of the listed cells only, which come in order."""
    keep = scores >= np.maximum(floor - 10.0**-decimals, np.finfo(np.float64).min)[rows]
    rows, columns, values = rows[keep], columns[keep], np.round(scores[keep], decimals)
    order = np.lexsort((columns, -values, rows))
    first = order[_place(rows[order]) < k]
    first.sort()
    return rows[first], columns[first], values[first]


def _place(rows: np.ndarray) -> np.ndarray:
    """The place of each entry within its run of equal row numbers."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))


def _ranked(candidates: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best rows per query with their rank."""
    rows = pd.concat(candidates, ignore_index=True)
    rows = rows.sort_values(["query_id", "similarity", "key"], ascending=[True, False, True])
    rows["rank"] = rows.groupby("query_id", sort=False).cumcount() + 1
    return rows[rows["rank"] <= k]


class _Best:
    """The best rows found so far for the queries of a tile, and what each of them has at rank k."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.values = np.full((len(query_ids), k), -np.inf)
        self.held, self.n_held = [], 0

    @property
    def floor(self) -> np.ndarray:
        return self.values[:, 0]

    def add(self, at_query: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(at_query):
            return
        self.held.append(pd.DataFrame({"query_id": self.query_ids[at_query], "key": keys, "similarity": values}))
        self.n_held += len(values)
        if self.n_held > 4 * self.k * len(self.query_ids):
            self.held = [_ranked(self.held, self.k)]
            self.n_held = len(self.held[0])
        touched, row = np.unique(at_query, return_inverse=True)
        both = np.full((len(touched), 2 * self.k), -np.inf)
        both[:, self.k :] = self.values[touched]
        order = np.lexsort((-values, row))
        both[row[order], _place(row[order])] = values[order]
        both.partition(self.k, axis=1)
        self.values[touched] = both[:, self.k :]


class _Search:
    """The task-side work: score tiles, keep the best rows per query."""

    def __init__(self, kernel, k: int, decimals: int, query_key: str, corpus_key: str):
        self.kernel, self.k, self.decimals = kernel, k, decimals
        self.query_key, self.corpus_key = query_key, corpus_key

    def load(self, tables: Iterable[pa.Table], key: str) -> list[tuple[np.ndarray, object]]:
        return [
            (tile.column(key).to_numpy(), self.kernel.load(tile)) for tile in _tiles(tables, key)
        ]

    def meet(self, best: _Best, queries, corpus_tile) -> None:
        """Add the best pairs of two tiles; what a query already has at rank k is its floor."""
        keys, corpus = corpus_tile
        at_query, at_key, values = self.kernel.best(queries, corpus, self.k, self.decimals, best.floor)
        best.add(at_query, keys[at_key], values)

    def all_queries(self, query_tiles, corpus: Iterable[pa.Table]) -> Iterator[pd.DataFrame]:
        """One partial answer for all queries over the corpus rows of this task."""
        bests = [_Best(ids, self.k) for ids, _ in query_tiles]
        for table in corpus:
            for tile in self.load([table], self.corpus_key):
                for best, (_, queries) in zip(bests, query_tiles):
                    self.meet(best, queries, tile)
        held = [frame for best in bests for frame in best.held]
        if held:
            yield _ranked(held, self.k)

    def each_query(self, corpus_tiles, queries: Iterable[pa.Table]) -> Iterator[pd.DataFrame]:
        """Complete answers for the queries of this task."""
        for table in queries:
            for ids, tile in self.load([table], self.query_key):
                best = _Best(ids, self.k)
                for corpus_tile in corpus_tiles:
                    self.meet(best, tile, corpus_tile)
                if best.held:
                    yield _ranked(best.held, self.k)


def _out_schema(queries: Side, corpus: Side) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.key_type),
            T.StructField("rank", T.IntegerType()),
            T.StructField("key", corpus.key_type),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _to_arrow(frame: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pandas(frame[schema.names], schema=schema, preserve_index=False)


def _stream(side: Side, columns, work, schema: T.StructType, tasks: int | None) -> DataFrame:
    """Run ``work`` over the rows of a side where they lie, or spread over ``tasks`` first."""
    arrow_schema = to_arrow_schema(schema)
    rows = side.rows.select(side.key, *columns)
    if tasks:
        rows = rows.repartition(tasks, side.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (pa.Table.from_batches([batch]) for batch in batches)
        for frame in work(tables):
            yield from _to_arrow(frame, arrow_schema).to_batches()

    return rows.mapInArrow(run, schema)


def _rank(candidates: DataFrame, k: int) -> DataFrame:
    """Merge partial answers; the group limit runs before the shuffle as well."""
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("key"))
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "key", "similarity")


def _waves(search: _Search, queries: Side, corpus: Side, sizes, schema: T.StructType, limits: Limits) -> DataFrame:
    """Partial answers when neither side fits: slices of the smaller side are broadcast in turn.

    Both sides are written first. The larger one is read once per slice, and only the k best rows per query leave
    a task. A slice's answers are written and its broadcast freed before the next is sent.
    """
    slice_queries = sizes["queries"] <= sizes["corpus"]
    cut, moving = (queries, corpus) if slice_queries else (corpus, queries)
    size = sizes["queries" if slice_queries else "corpus"]
    context = cut.rows.sparkSession.sparkContext
    n_waves = max(1, math.ceil(2 * size / limits.broadcast_bytes))
    if n_waves > limits.most_waves:
        return _shares(search, queries, corpus, sizes, schema, limits)
    # Both sides are computed once; every slice reads them from files.
    columns = search.kernel.columns
    cut_rows = written(cut.rows.select(cut.key, *columns), "wave-slices")
    moving = replace(moving, rows=written(moving.rows.select(moving.key, *columns), "wave-rows"))
    parts = []
    for number in range(n_waves):
        own = cut_rows.where(F.pmod(F.xxhash64(cut.key), F.lit(n_waves)) == number)
        collected = own.toArrow()
        if not collected.num_rows:
            continue
        if n_waves > 1 and collected.nbytes > 4 * limits.broadcast_bytes:
            raise ValueError(f"a slice of {collected.nbytes} bytes is too large to broadcast")
        held = context.broadcast(search.load([collected], cut.key))
        work = search.all_queries if slice_queries else search.each_query
        found = _stream(moving, columns, lambda tables, held=held, work=work: work(held.value, tables), schema, None)
        parts.append(written(found, "wave-matches"))
        held.destroy()  # the slice's answers are written: no task asks for it again
    if not parts:
        return cut.rows.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)


def _shares(search: _Search, queries: Side, corpus: Side, sizes, schema: T.StructType, limits: Limits) -> DataFrame:
    """Partial answers by one shuffle, without the driver: every task holds a share of one side and reads all rows of the other.

    A share takes up to ``share_bytes``, so what is shuffled is one side once and the other as often as there are shares. Queries
    are held unless that side is so much smaller that its copies and its partial answers are less to send than the corpus.
    """
    columns = search.kernel.columns
    context = queries.rows.sparkSession.sparkContext
    hold_queries = sizes["corpus"] <= 2 * sizes["queries"]
    held_size = sizes["queries" if hold_queries else "corpus"]
    n_shares = max(context.defaultParallelism, math.ceil(held_size / limits.share_bytes))

    def placed(side: Side, other: Side, role: str, holds: bool) -> DataFrame:
        own = F.pmod(F.xxhash64(side.key), F.lit(n_shares)).cast("int")
        share = own if holds else F.explode(F.sequence(F.lit(0), F.lit(n_shares - 1)))
        names = {"query_key": F.lit(None).cast(queries.key_type), "corpus_key": F.lit(None).cast(corpus.key_type)}
        names[role] = F.col(side.key)
        return side.rows.select(share.alias("share"), F.lit(not holds).alias("streams"), *(c.alias(n) for n, c in names.items()), *columns)

    both = placed(queries, corpus, "query_key", hold_queries).unionAll(placed(corpus, queries, "corpus_key", not hold_queries))
    dealt = both.repartitionById(n_shares, F.col("share")).sortWithinPartitions("share", "streams")
    held_key, moving_key = ("query_key", "corpus_key") if hold_queries else ("corpus_key", "query_key")
    task = _Search(search.kernel, search.k, search.decimals, "query_key", "corpus_key")
    arrow_schema = to_arrow_schema(schema)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        """Pieces of batches that are of one share and one side."""
        for batch in batches:
            marks = pc.add(pc.multiply(batch.column("share").cast("int64"), 2), batch.column("streams").cast("int64"))
            marks = marks.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(marks, prepend=-1))
            for start, end in zip(starts, np.append(starts[1:], len(marks))):
                yield (int(marks[start]) // 2, bool(marks[start] % 2)), pa.Table.from_batches([batch.slice(start, end - start)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(runs(batches), key=lambda piece: piece[0][0]):
            sides = groupby(pieces, key=lambda piece: piece[0][1])
            streams, tables = next(sides)
            if streams:  # nothing to hold: no row of this share meets another
                continue
            tiles = task.load(_gathered([table for _, table in tables]), held_key)
            moving = ((table for _, table in tables) for _, tables in sides)
            work = task.all_queries if hold_queries else task.each_query
            for tables in moving:
                for frame in work(tiles, tables):
                    yield from _to_arrow(frame, arrow_schema).to_batches()

    return dealt.mapInArrow(run, schema)


def _gathered(tables: list[pa.Table]) -> list[pa.Table]:
    return [pa.concat_tables(tables)] if tables else []


def _tasks_needed(n_pairs: int, moving_bytes: int, cores: int, limits: Limits) -> int | None:
    """How far to spread the streaming side, if its natural splits would leave cores idle.

    A side of at least one full split per core is never shuffled for this.
    """
    natural = max(1, moving_bytes // FULL_SPLIT)
    wanted = min(math.ceil(n_pairs / limits.pairs_per_task), 4 * cores)
    return wanted if natural < min(cores, wanted) else None


def search(
    queries: Side,
    corpus: Side,
    k: int,
    kernel,
    decimals: int = 9,
    strategy: str = "auto",
    limits: Limits = Limits(),
) -> Matches:
    """The k best corpus rows of every query, ties by key.

    Similarities are rounded to ``decimals`` before ranking so that the answer
    does not depend on how rows were grouped into blocks. Keys must be unique
    on either side; rows without a key never match. A side is broadcast only when its measured size is within
    ``limits``; a requested strategy that breaks them raises.
    """
    queries, corpus = (replace(side, rows=side.rows.where(F.col(side.key).isNotNull())) for side in (queries, corpus))
    sides = {"queries": queries, "corpus": corpus}
    counts = {name: side.count() for name, side in sides.items()}
    sizes = {name: side.bytes_for(counts[name]) for name, side in sides.items()}
    task = _Search(kernel, k, decimals, queries.key, corpus.key)
    schema = _out_schema(queries, corpus)
    fits = {name: size <= limits.broadcast_bytes for name, size in sizes.items()}
    fits["queries"] &= counts["queries"] * k <= limits.partial_rows

    if strategy == "auto":
        smaller_first = sorted(sides, key=lambda name: (counts[name], name))
        strategy = next((name for name in smaller_first if fits[name]), "waves")
    elif strategy not in ("queries", "corpus", "waves"):
        raise ValueError(f"unknown strategy {strategy!r}")
    elif not fits.get(strategy, True):
        raise ValueError(f"the {strategy} side is too large to broadcast")

    at_most = counts["queries"] * k
    if strategy == "waves":
        return Matches(_rank(_waves(task, queries, corpus, sizes, schema, limits), k), at_most)

    held_side = sides[strategy]
    moving = "corpus" if strategy == "queries" else "queries"
    context = queries.rows.sparkSession.sparkContext
    n_pairs = counts["queries"] * counts["corpus"]
    spread = _tasks_needed(n_pairs, sizes[moving], context.defaultParallelism, limits)
    collected = held_side.rows.select(held_side.key, *kernel.columns).toArrow()
    held = context.broadcast(task.load([collected], held_side.key))
    if strategy == "queries":
        partial = _stream(
            corpus, kernel.columns, lambda tables: task.all_queries(held.value, tables), schema, spread
        )
        return Matches(_rank(partial, k), at_most)
    complete = _stream(
        queries, kernel.columns, lambda tables: task.each_query(held.value, tables), schema, spread
    )
    return Matches(complete, at_most)
