"""Quality rules on repetition: a suffix array over the words of each text.

All texts of a batch share one suffix array; a word is numbered together with its
text, so no two texts have a word in common and every repeat lies within one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.words import Words, is_space, mix, pieces, split_words

SYMBOLS = "#*$%&|<>"


def doubled_ranks(ids: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order, and for each t the ranks of the suffixes by their first 2**t words.

    ``ids`` numbers the words, ``row_end`` is the end of each word's text. Equal ranks
    at level t mean equal prefixes of 2**t words. Only suffixes that still share their
    rank are sorted again, so a level costs as much as there are repeats that long.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = _bucket_starts(ids[order], order, np.zeros(n, np.int64), np.arange(n))
    levels, length = [rank], 1
    while len(active := _shared(rank)):
        ahead = active + length
        inside = ahead < row_end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        old = rank[active]
        key_change = np.concatenate(([True], (old[1:] != old[:-1]) | (second[1:] != second[:-1])))
        bucket = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), np.arange(len(old)), 0))
        start = np.maximum.accumulate(np.where(key_change, np.arange(len(old)), 0))
        rank = rank.copy()
        rank[active] = old + (start - bucket)
        levels.append(rank)
        length *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def _bucket_starts(sorted_ids, order, rank, index):
    change = np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])) if len(sorted_ids) else index
    rank[order] = np.maximum.accumulate(np.where(change, index, 0)) if len(sorted_ids) else index
    return rank


def _shared(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1) if len(rank) else rank


def longest_repeats(ids: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat that starts there.

    It is the greater of the common prefixes with the two neighbours in suffix order.
    """
    n = len(ids)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    suffixes, levels = doubled_ranks(ids, row_end)
    left, right = suffixes[:-1], suffixes[1:]
    near = levels[0][left] == levels[0][right]
    left, right = left[near], right[near]
    common = np.zeros(len(left), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < n) & (b < n)
        rank = levels[t]
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        common += same.astype(np.int64) << t
    np.maximum.at(best, left, common)
    np.maximum.at(best, right, common)
    return best


def _cover(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """True where at least one of the spans lies."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) > 0


@dataclass(frozen=True)
class Limits:
    """A repeat counts from ``min_words`` words on; a text fails beyond either limit.

    ``max_covered_percent``: share of the words that lie in repeats. ``max_longest_percent``: share of
    the words that the longest repeat takes. ``min_total`` and ``max_window_percent`` are the base rules.
    """

    min_words: int = 10
    max_covered_percent: int = 30
    max_longest_percent: int = 30
    min_total: int = 50
    max_window_percent: int = 50


def _line_repeats(words: Words) -> np.ndarray:
    """Lines holding a word that equal an earlier line of their text, counted per text."""
    data, offsets = words.data, words.offsets
    feeds = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1], feeds + 1)
    start = start[start < len(data)]
    row = np.searchsorted(offsets, start, side="right") - 1
    next_feed = np.append(feeds, len(data))[np.searchsorted(feeds, start)]
    end = np.minimum(next_feed, offsets[row + 1])
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    lines = Words(data, offsets, row[filled], start[filled], end[filled], words.n_rows)
    tagged = mix(lines.hashes() + lines.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(tagged, return_index=True)
    return np.bincount(lines.row, minlength=words.n_rows) - np.bincount(lines.row[first], minlength=words.n_rows)


def measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    words = split_words(texts, lower=False)
    n, rows = len(words.row), words.n_rows
    count = words.counts()
    row_end = np.cumsum(count)[words.row] if n else words.row
    tagged = mix(words.hashes() + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ids = np.unique(tagged, return_inverse=True)[1].astype(np.int64)

    inside = np.flatnonzero(np.arange(n) + 3 <= row_end)
    spread = np.uint64(0xA24BAED4963EE407)
    window = mix(mix(mix(tagged[inside]) * spread + tagged[inside + 1]) * spread + tagged[inside + 2]) if n else tagged
    kind, number = np.unique(window, return_inverse=True, return_counts=True)[1:]
    twice = inside[number[kind] > 1]
    in_window = _cover(twice, np.full(len(twice), 3), n)

    repeat = longest_repeats(ids, row_end)
    span = np.flatnonzero(repeat >= limits.min_words)
    covered = _cover(span, repeat[span], n)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.row, repeat)

    data, in_row = words.data, np.searchsorted(words.offsets, np.arange(len(words.data)), side="right") - 1
    heads = ~is_space(data) & ((data & 0xC0) != 0x80)
    per_row = lambda mask, row: np.bincount(row[mask], minlength=rows)
    return {
        "n_words": count,
        "word_chars": per_row(heads, in_row),
        "n_symbols": per_row(np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8)), in_row),
        "n_dup_lines": _line_repeats(words),
        "n_repeat_words": per_row(in_window, words.row),
        "covered_words": per_row(covered, words.row),
        "longest_repeat": longest,
    }


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repetition_rules(
    documents: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """Judge each text by how much of it repeats.

    Returns the key, ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (words in 3-word windows found twice), ``covered_words`` (words in repeats of
    at least ``limits.min_words`` words), ``longest_repeat`` (words), ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged
    one by one and alike. Other columns are left out, so their names cannot clash. An
    empty table gives no rows. Texts are read whole in the task that scans them; a text
    needs about 200 bytes of memory per word there. Nothing is shuffled.
    """
    kind = documents.schema[key].dataType.simpleString()
    columns = ", ".join(f"{name} long" for name in _MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                found = measure(batch.column(1), limits)
                n = found["n_words"]
                failed = (n < limits.min_total) | (100 * found["n_repeat_words"] > limits.max_window_percent * n)
                over = (100 * found["covered_words"] > limits.max_covered_percent * n) | (
                    100 * found["longest_repeat"] > limits.max_longest_percent * n
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(found[c], pa.int64()) for c in _MEASURES)]
                    + [pa.array(failed), pa.array(~failed & ~over)],
                    [key, *_MEASURES, "base_failed", "kept"],
                )

    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return source.mapInArrow(run, f"`{key}` {kind}, {columns}, base_failed boolean, kept boolean")
