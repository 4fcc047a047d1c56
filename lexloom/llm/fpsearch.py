"""Ranked lexical search: branch and bound on prefix trees of documents.

Documents are reduced to the terms that the searched items hold, with the most frequent term first. Those of a task
share the paths of a prefix tree. Every subtree knows the most often any of its documents holds each
term and the least length factor among them, which together bound its scores; an item walks the tree depth
first, best child first, and leaves out subtrees that cannot reach its kth score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.storage import stored

#: Terms in UTF-8 whose ASCII letters are lower-case: runs of digits, letters and whatever is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    """``k`` results an item. ``wave_bytes`` bounds the terms of the items that are searched at a time; a
    greater table of items is searched in several waves. A tree takes documents until they hold ``tree_entries``
    different terms together, and is parted where its subtrees times the terms searched exceed ``tree_cells``.
    Subtrees of up to ``bucket`` documents are not divided."""

    k: int = 20
    wave_bytes: int = 2 << 20
    tree_entries: int = 400_000
    tree_cells: int = 12 << 20
    bucket: int = 16


def term_counts(text: str | None) -> Counter:
    return Counter(TERM.findall(text.encode("utf-8", "surrogatepass").lower())) if text else Counter()


def length_factor(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 75 + (25 * n * documents) // max(terms, 1)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Grows with ``tf`` and falls with ``m``, so the greatest tf and least m of a set bound it."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Node:
    low: int
    high: int
    children: list[int] = field(default_factory=list)


class Tree:
    """Prefix tree of documents: rows of (terms by frequency rank, times, length factor), in path order.

    A node is a range of the rows in the order of their paths. ``most[term, node]`` is the greatest number of times, ``least[node]``
    the smallest length factor in its subtree.
    """

    def __init__(self, first: np.ndarray, ranks: np.ndarray, times: np.ndarray, m: np.ndarray, bucket: int):
        wide = ranks.astype(">u4")
        paths = [wide[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        paths = [paths[i] for i in self.order]
        sizes = np.diff(first)[self.order]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(first[:-1][self.order] - self.first[:-1], sizes) + np.arange(self.first[-1])
        self.ranks, self.times = ranks[take], times[take]
        self.m = m[self.order]
        self.gain = saturation(self.times, np.repeat(self.m, sizes))
        self.nodes: list[Node] = []
        self._grow(paths, bucket)

    def _grow(self, paths: list[bytes], bucket: int) -> None:
        self.nodes.append(Node(0, len(paths)))
        todo = [0]
        while todo:
            node = self.nodes[todo.pop()]
            low, high = node.low, node.high
            if high - low <= bucket or paths[low] == paths[high - 1]:
                continue
            shared = _shared_terms(paths[low], paths[high - 1])
            start = low
            while start < high:  # small neighbours among the children go into one bucket
                stop = start
                while stop < high:
                    after = _end_of_child(paths, stop, high, shared)
                    if stop > start and after - start > bucket:
                        break
                    stop = after
                node.children.append(len(self.nodes))
                self.nodes.append(Node(start, stop))
                if stop - start > bucket:
                    todo.append(node.children[-1])
                start = stop

    def bound(self, n_terms: int) -> Tree:
        self.most = np.zeros((n_terms, len(self.nodes)), np.int32)
        self.least = np.empty(len(self.nodes), np.int64)
        for i in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
            node = self.nodes[i]
            self.least[i] = self.m[node.low : node.high].min()
            if node.children:
                self.most[:, i] = self.most[:, node.children].max(axis=1)
            else:
                a, b = self.first[node.low], self.first[node.high]
                np.maximum.at(self.most[:, i], self.ranks[a:b], self.times[a:b].astype(np.int32))
        return self

    def search(self, terms: np.ndarray, weights: np.ndarray, all_weights: np.ndarray, best: list, keys: list, k: int) -> int:
        """Bring the heap ``best`` of (score, minus key) up to date; returns how many documents were scored.

        A null key counts as the greatest. Subtrees that can only reach the kth score are walked, as a smaller key may win.
        """
        least = lambda: best[0][0] if len(best) == k else 1
        bounds = (weights[:, None] * saturation(self.most[terms].astype(np.int64), self.least)).sum(axis=0)
        todo, scored = [0], 0
        while todo:
            i = todo.pop()
            if bounds[i] < least():
                continue
            node = self.nodes[i]
            if node.children:
                todo += sorted(node.children, key=bounds.__getitem__)  # the best is taken first
                continue
            a, b = self.first[node.low], self.first[node.high]
            gains = all_weights[self.ranks[a:b]] * self.gain[a:b]
            scores = np.add.reduceat(gains, self.first[node.low : node.high] - a)
            scored += len(scores)
            for place in np.flatnonzero(scores >= least()):
                key = keys[self.order[node.low + place]]
                entry = (int(scores[place]), -(2**63) if key is None else -key)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def trees(first, ranks, times, m, n_terms: int, settings: Settings) -> Iterator[tuple[int, Tree]]:
    """Trees over these documents and the number of each one's first document."""
    tree = Tree(first, ranks, times, m, settings.bucket)
    if len(tree.nodes) * n_terms <= settings.tree_cells or len(m) <= settings.bucket:
        yield 0, tree.bound(n_terms)
        return
    half = len(m) // 2
    cut = first[half]
    for offset, tree in trees(first[: half + 1], ranks[:cut], times[:cut], m[:half], n_terms, settings):
        yield offset, tree
    for offset, tree in trees(first[half:] - cut, ranks[cut:], times[cut:], m[half:], n_terms, settings):
        yield half + offset, tree


def _shared_terms(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differs = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(differs[0]) if len(differs) else n) // 4


def _end_of_child(paths: list[bytes], low: int, high: int, shared: int) -> int:
    """End of the rows from ``low`` on whose path goes on with the same term after ``shared`` terms."""
    head = paths[low][: 4 * shared + 4]
    step, end = 1, low + 1
    while end < high and paths[end][: 4 * shared + 4] == head:  # doubling steps, then halves
        low, end, step = end, end + step, step * 2
    end = min(end, high)
    while low + 1 < end:
        middle = (low + end) // 2
        if paths[middle][: 4 * shared + 4] == head:
            low = middle
        else:
            end = middle
    return end


def rank_documents(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """The ``k`` best documents of each item: item key, ``rank`` (from 1), key, ``score``.

    A term's weight falls with the number of documents that hold it; its share of a score grows with the times it stands in
    a document and falls with the document's length. Equal scores go by ascending key, null keys last.

    Null and empty texts hold no term: such documents are never found, such items find none. Repeated documents are ranked
    one by one, every row of ``items`` is searched for itself. Other columns are left out, so their names
    cannot clash; the keys of documents are whole numbers. An empty table on either side gives no rows.
    Texts are read whole, once a wave of items; reduced documents are written, and trees built from them in the tasks that read them.
    """
    spark = documents.sparkSession
    searched = stored(
        items.select(items[item_key].alias("item"), items[item_text].alias("text"))
        .mapInArrow(_count_terms, f"item {items.schema[item_key].dataType.simpleString()}, terms array<binary>, times array<long>")
        .withColumn("number", F.monotonically_increasing_id())
        .withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16)),
        "items",
    )
    rows = documents.select(documents[key].cast("long").alias("key"), documents[text].alias("text"))
    total = searched.agg(F.sum("bytes")).first()[0] or 0
    waves = max(1, -(-total // settings.wave_bytes))
    found = []
    for wave in range(waves):
        part = searched.where(F.pmod(F.xxhash64("number"), F.lit(waves)) == wave) if waves > 1 else searched
        found.append(_search_wave(rows, part, settings))
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)
    best = best.join(searched.select("number", "item"), "number")
    return best.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [term_counts(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item"),
                pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
            ],
            ["item", "terms", "times"],
        )


def _search_wave(rows: DataFrame, part: DataFrame, settings: Settings) -> DataFrame:
    """Best documents of the items of one wave, whose terms fit the bound: ``number``, ``key``, ``score``."""
    items = [(r["number"], [bytes(t) for t in r["terms"]], r["times"]) for r in part.collect()]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms, _ in items for t in terms}))}
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch.column("text"):
                counts = term_counts(text.as_py())
                kept = counts.keys() & known.keys()
                sizes.append(counts.total())
                terms.append([known[t] for t in kept])
                times.append([counts[t] for t in kept])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int64())),
                ],
                ["key", "size", "terms", "times"],
            )

    vectors = stored(
        rows.mapInArrow(reduce, "key long, size long, terms array<int>, times array<long>").where("size > 0"), "vectors"
    )
    documents, terms = vectors.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row per term of the wave
        holding[r["term"]] = r["count"]

    by_frequency = np.argsort(-holding, kind="stable")
    rank_of = np.empty(len(vocabulary), np.int64)
    rank_of[by_frequency] = np.arange(len(vocabulary))
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding]
    asked = []
    for number, item_terms, item_times in items:
        places = np.array([vocabulary[t] for t in item_terms], np.int64)
        weights = np.array([weight[p] * c for p, c in zip(places, item_times, strict=True)], np.int64)
        asked.append((number, rank_of[places], weights))
    plan = rows.sparkSession.sparkContext.broadcast((asked, rank_of, documents, terms))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rank_of, documents, terms = plan.value
        best: list[list] = [[] for _ in asked]  # heaps of (score, minus key)
        for first, ranks, times, sizes, keys in _gather(batches, rank_of, settings.tree_entries):
            m = length_factor(sizes, documents, terms)
            for offset, tree in trees(first, ranks, times, m, len(rank_of), settings):
                all_weights = np.zeros(len(rank_of), np.int64)
                for heap, (_, item_terms, weights) in zip(best, asked, strict=True):
                    all_weights[item_terms] = weights
                    tree.search(item_terms, weights, all_weights, heap, keys[offset:], settings.k)
                    all_weights[item_terms] = 0
        out = [(n, None if k == -(2**63) else -k, s) for (n, _, _), heap in zip(asked, best, strict=True) for s, k in heap]
        for start in range(0, len(out), 10_000):
            numbers, keys, scores = zip(*out[start : start + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (numbers, keys, scores)], ["number", "key", "score"])

    useful = vectors.where(F.size("terms") > 0)
    return useful.mapInArrow(search, "number long, key long, score long")


def _gather(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray, most_entries: int):
    """Reduced documents of about ``most_entries`` terms at a time, each row's terms in order of rank."""
    kept, entries = [], 0
    for batch in batches:
        lengths = np.diff(np.asarray(batch.column("terms").offsets))
        start = 0
        while start < batch.num_rows:
            room = max(most_entries - entries, 1)
            stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), room, side="right")))
            kept.append(batch.slice(start, stop - start))
            entries += int(lengths[start:stop].sum())
            start = stop
            if entries >= most_entries:
                yield _by_rank(kept, rank_of)
                kept, entries = [], 0
    if kept:
        yield _by_rank(kept, rank_of)


def _by_rank(batches: list[pa.RecordBatch], rank_of: np.ndarray):
    whole = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: whole.column(name).combine_chunks()
    lengths = np.asarray(column("terms").value_lengths(), dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    ranks = rank_of[np.asarray(column("terms").flatten())]
    times = np.asarray(column("times").flatten()).astype(np.int64)
    order = np.lexsort((ranks, np.repeat(np.arange(len(lengths)), lengths)))
    return first, ranks[order], times[order], np.asarray(column("size")).astype(np.int64), column("key").to_pylist()
