"""Language-model scores from an n-gram trie in Elias-Fano form.

The texts are dealt into parts of bounded size, which are shuffled as numbers of words. Every part asks for the training counts of the
words and word pairs it holds, each by a 64-bit hash, and contributes its own counts; shards
of the hash range add them up over the whole corpus and answer. With order 3 a second round asks in the same way for the
triples that the shards' word on each pair leaves open. A part then builds the trie of what it
asked for and scores its texts with it. So the counts cover everything, while no task ever holds more
of the model than its own texts can use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.eliasfano import EliasFano, mapped
from lexloom.llm.labelled import fold
from lexloom.llm.words import BATCH_BYTES, mix, pieces, split_words

END, START = np.uint64(0x45A1B2C3D4E5F607), np.uint64(0x73AF00D15EA5E001)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SEARCH = 1 << 14
_ROW = 16  # bytes that a text counts for besides its own, so that empty ones fill parts too


@dataclass(frozen=True)
class Settings:
    """``strength``: how many observations the distribution of words alone is worth after one word of context;
    ``triple_strength``: how many that after one word is worth after two. Of 0.2 to 500, 2 to 5 gave held-out documents of the largest
    plain table the greatest probability (-3.33 a token, base 10, where 500 gives -3.58); ``strength`` between 50 and 5,000 matters little.

    ``add``: constant added to word counts. ``part_bytes``: about the bytes of text of a part. ``levels``: number
    of values a level's log probabilities are rounded to. ``order``: 2 or 3, words that a score looks at, its own among them.
    """

    strength: float = 500.0
    triple_strength: float = 3.0
    add: float = 0.1
    part_bytes: int = 8 << 20
    levels: int = 65536
    order: int = 2

    def __post_init__(self):
        if self.order not in (2, 3):
            raise ValueError(f"order is 2 or 3, not {self.order}")


@dataclass
class Tokens:
    """Words of each text and its end, one text after the other: their numbers among ``keys``, the sorted hashes; ``count``: tokens of each text."""

    keys: np.ndarray
    word: np.ndarray
    count: np.ndarray

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.first = np.zeros(len(self.word), bool)
        self.first[np.cumsum(self.count) - self.count] = True

    @property
    def pair(self) -> np.ndarray:
        """Hash of each token and what is before it, which may be the start of the text."""
        word = self.keys[self.word]
        before = np.concatenate((word[:0], [START], word[:-1]))[: len(word)]
        before[self.first] = START
        return mix(before * _SPREAD + word)

    @property
    def third(self) -> np.ndarray:
        """Places of the tokens that have two before them, the start of the text among them."""
        return np.flatnonzero(~self.first)


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of each text, and hashes of its words and its end, one text after the other."""
    words = split_words(texts)
    count = words.counts() + 1
    word = np.full(count.sum(), END, np.uint64)
    inner = np.ones(len(word), bool)
    inner[np.cumsum(count) - 1] = False
    word[inner] = words.hashes()
    return count, word


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and the number of every value among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(values)]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def _in_order(values: np.ndarray) -> np.ndarray:
    """Places of the values in order, equal ones by place; quicker than a stable sort."""
    order = np.argsort(values)
    ordered = values[order]
    run = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))[: len(values)]
    return np.sort((run << 32) | order) & 0xFFFFFFFF if len(values) < 1 << 31 else np.argsort(values, kind="stable")


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers with all first bytes, then all second bytes and so on, which packs well."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    size = next(w for w in (1, 2, 4, 8) if w >= width)
    raw = values.astype(f"<u{size}").view(np.uint8).reshape(-1, size)[:, :width]
    return bytes([width]) + np.ascontiguousarray(raw.T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _squeezed(values: np.ndarray) -> bytes:
    """Planes of integers that are unevenly spread, compressed; behind a zero, their length in 8 bytes."""
    raw = _planes(values)
    packed = pa.Codec("zstd").compress(raw, asbytes=True)
    return raw if len(packed) + 9 > len(raw) else b"\0" + len(raw).to_bytes(8, "little") + packed


def _from_squeezed(raw: bytes) -> np.ndarray:
    return _from_planes(raw if raw[0] else pa.Codec("zstd").decompress(raw[9:], int.from_bytes(raw[1:9], "little"), asbytes=True))


_PART = pa.schema(
    [("part", pa.int64()), *((c, pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("learned", pa.bool_())))]
    + [(c, pa.binary()) for c in ("count", "keys", "often", "rank")]
)
_PART_DDL = "part long, doc_id array<long>, held_out array<boolean>, learned array<boolean>, count binary, keys binary, often binary, rank binary"


def _part(number: int, rows: list[pa.RecordBatch], counts: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
    """One row for a part: its keys, how often each stands there, and the tokens by rank, the most frequent key first."""
    keys, word = np.unique(np.concatenate(words), return_inverse=True)
    often = np.bincount(word)
    rank = np.empty(len(keys), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(keys))
    of_rows = pa.Table.from_batches(rows).to_pydict()
    return pa.RecordBatch.from_pydict(
        {"part": [number]}
        | {c: [of_rows[c]] for c in ("doc_id", "held_out", "learned")}
        | {"count": [_squeezed(np.concatenate(counts))], "keys": [_planes(np.diff(keys, prepend=np.uint64(0)))]}
        | {"often": [_squeezed(often)], "rank": [_squeezed(rank[word])]},
        schema=_PART,
    )


def _tokens(part: pa.Table) -> Tokens:
    count, often, rank = (_from_squeezed(part[c][0].as_py()).astype(np.int64) for c in ("count", "often", "rank"))
    return Tokens(np.cumsum(_from_planes(part["keys"][0].as_py())), np.argsort(-often, kind="stable")[rank], count)


def _rows(part: pa.Table, column: str) -> pa.Array:
    return part[column].combine_chunks().flatten()


def _deal(part_bytes: int):
    """Rows one after the other into parts of about ``part_bytes`` of text; a longer text is a part of its own or the last of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows, counts, words, size = [], [], [], 0
        for batch in batches:
            for piece in pieces(batch, "text", min(BATCH_BYTES, part_bytes)):
                count, word = _hashes(piece.column("text"))
                rows.append(piece.select(["doc_id", "held_out", "learned"]))
                counts.append(count)
                words.append(word)
                size += pc.sum(pc.binary_length(piece.column("text"))).as_py() + _ROW * len(piece)
                if size >= part_bytes:
                    yield _part(number, rows, counts, words)
                    number += 1
                    rows, counts, words, size = [], [], [], 0
        if rows:
            yield _part(number, rows, counts, words)

    return run


_ASK = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASK_DDL = "shard int, part long, level int, keys binary, counts binary"
_ANSWER = pa.schema([("part", pa.int64()), ("shard", pa.int32()), ("level", pa.int32()), ("totals", pa.binary())])
_ANSWER_DDL = "part long, shard int, level int, totals binary"
_SIZE = pa.schema([("kinds", pa.int64()), ("tokens", pa.int64())])
_SIZE_DDL = "kinds long, tokens long"


def _requests(part: int, level: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard of the hash range that has some of the sorted keys, which count from its beginning there."""
    limits = np.array([(s << 64) // shards for s in range(shards)], np.uint64)
    edges = np.append(np.searchsorted(keys, limits), len(keys))
    for shard in np.flatnonzero(np.diff(edges)):
        own = slice(edges[shard], edges[shard + 1])
        steps = np.diff(keys[own], prepend=limits[shard])
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "part": [part], "level": [level], "keys": [_planes(steps)], "counts": [_squeezed(counts[own])]}, schema=_ASK
        )


def _ask(shards: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches))
        found = _tokens(part)
        learned = _rows(part, "learned").to_numpy(zero_copy_only=False)[found.row]
        pairs, _, pair = distinct(found.pair)
        for level, keys, number in ((1, found.keys, found.word), (2, pairs, pair)):
            counts = np.bincount(number[learned], minlength=len(keys)).astype(np.uint64)
            yield from _requests(key[0].as_py(), level, keys, counts, shards)

    return run


def _asked(batches: Iterator[pa.RecordBatch], levels: tuple[int, ...]) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Part, keys and counts of each row of a shard, by level."""
    asked: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {level: [] for level in levels}
    for batch in batches:
        for part, level, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "level", "keys", "counts")), strict=True):
            if level in asked:
                asked[level].append((part, np.cumsum(_from_planes(keys)), _from_squeezed(counts)))
    return asked


def _totals(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key among the shard's, and the count of each number over all parts."""
    number = distinct(np.concatenate([r[1] for r in rows]))[2]
    return number, np.bincount(number, weights=np.concatenate([r[2] for r in rows]).astype(np.float64))


def _reply(part: int, shard: int, level: int, totals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "level": [level], "totals": [_squeezed(totals)]}, schema=_ANSWER)


def _answer(order: int, only_common: bool = False):
    """Totals of the keys of each part; of pairs, if ``only_common``, just whether they are common: learned from and held by more parts than one."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for level, rows in _asked(batches, (2,) if only_common else (1, 2, 3)).items():
            if not rows:
                continue
            number, totals = _totals(rows)
            totals = totals.astype(np.uint64)
            if order > 2 and level == 2:
                common = ((np.bincount(number) > 1) & (totals > 0)).astype(np.uint64)
                totals = common if only_common else totals * np.uint64(2) + common  # the lowest bit
            at = 0
            for part, keys, _ in rows:
                yield _reply(part, key[0].as_py(), level, totals[number[at : at + len(keys)]])
                at += len(keys)

    return run


def _answered(answers: pa.Table, levels: tuple[int, ...]) -> dict[int, np.ndarray]:
    """By level, what was answered for the sorted keys of a part."""
    rows = sorted(zip(*(answers[c].to_pylist() for c in ("level", "shard", "totals")), strict=True), key=lambda r: r[:2])
    none = [np.zeros(0, np.uint64)]
    return {k: np.concatenate([_from_squeezed(t) for level, _, t in rows if level == k] or none) for k in levels}


@dataclass
class Triples:
    """Distinct triples of a part in the order of their hashes: the pairs (by number) they begin and end with.

    ``own``: how often the part learns from each. ``open_``: whether another part may hold it as well. A triple of a pair that
    only this part holds, or that nothing was learned of, stands in no other part that is learned from, so ``own``
    is its total.
    """

    keys: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    number: np.ndarray
    own: np.ndarray
    open_: np.ndarray


def _check(answered: np.ndarray, asked: np.ndarray) -> None:
    if len(answered) != len(asked):
        raise ValueError("a part has other rows than when it asked: the documents come in another order each time, so checkpoint them")


def _triples(found: Tokens, pairs: np.ndarray, pair: np.ndarray, learned: np.ndarray, common: np.ndarray) -> Triples:
    """``pairs``: hashes by number; ``pair``: number of each token's pair; ``common``: of each number, what the shards told."""
    at = found.third
    keys, some, number = distinct(mix(pairs[pair[at - 1]] * _SPREAD + found.keys[found.word[at]]))
    head, tail = pair[at[some] - 1], pair[at[some]]
    own = np.bincount(number[learned[at]], minlength=len(keys)).astype(np.uint64)
    # both tests depend on the pair alone, so parts agree on which triples are asked for
    return Triples(keys, head, tail, number, own, common[head] & common[tail])


def _ask_triples(shards: int):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(part):
            return _ASK.empty_table()
        found = _tokens(part)
        pairs, _, pair = distinct(found.pair)
        learned = _rows(part, "learned").to_numpy(zero_copy_only=False)[found.row]
        common = _answered(answers, (2,))[2]
        _check(common, pairs)
        triples = _triples(found, pairs, pair, learned, common.astype(bool))
        keys, counts = triples.keys[triples.open_], triples.own[triples.open_]
        return pa.Table.from_batches(_requests(key[0].as_py(), 3, keys, counts, shards), schema=_ASK)

    return run


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct trained words and trained tokens of a shard."""
    rows = _asked(batches, (1,))[1]
    totals = _totals(rows)[1] if rows else np.zeros(0)
    yield pa.RecordBatch.from_pydict({"kinds": [int((totals > 0).sum())], "tokens": [int(totals.sum())]}, schema=_SIZE)


class Quantised:
    """Log probabilities rounded to the means of equally filled bins; a bin number per value."""

    def __init__(self, values: np.ndarray, levels: int):
        order = _in_order(values)
        bins = np.empty(len(values), np.int64)
        bins[order] = np.arange(len(values)) * min(levels, max(len(values), 1)) // max(len(values), 1)
        total = np.bincount(bins, weights=values)
        self.means = total / np.maximum(np.bincount(bins), 1)
        self.bins = bins.astype(np.uint16 if levels <= 65536 else np.uint32)

    def get(self, index: np.ndarray) -> np.ndarray:
        return self.means[self.bins[index]]


class Trie:
    """Words, below each word its successors, below each pair those of its two words: quantised log10 probabilities.

    Words are numbered in hash order. ``pointers`` tell where the successors of a word begin and end, ``third_pointers``
    those of a pair; a successor is searched between them alone. What follows a pair g h is numbered by its place among the
    successors of h, so that numbers on the third level are small: any word that follows g h follows h. To keep a level
    monotone, each context's numbers are raised by its own number times the level's ``span``.
    """

    def __init__(self, n_words: int, word: np.ndarray, context: np.ndarray, log_word, log_left, log_pair, levels: int):
        self.levels, self.span = levels, n_words
        order, self.successors, self.pointers = self._below(context, word, n_words, self.span)
        self.words, self.left, self.pairs = Quantised(log_word, levels), Quantised(log_left, levels), Quantised(log_pair[order], levels)
        self._map(self.successors, self.pointers, self.words, self.left, self.pairs)

    def deepen(self, head: np.ndarray, tail: np.ndarray, shared: np.ndarray, log_triple, pair: np.ndarray, log_left):
        """Add triples g h w by the places of the pairs g h (``head``) and h w (``tail``) and the number of h (``shared``);
        ``log_left``: what the pair of each place ``pair`` leaves to the shorter context."""
        left = np.zeros(self.successors.n)
        left[pair] = log_left
        number = tail - self.pointers.all()[shared]
        self.third_span = int(number.max(initial=0)) + 1
        order, self.thirds, self.third_pointers = self._below(head, number, self.successors.n, self.third_span)
        self.pair_left, self.triples = Quantised(left, self.levels), Quantised(log_triple[order], self.levels)
        self._map(self.thirds, self.third_pointers, self.pair_left, self.triples)

    @staticmethod
    def _below(context: np.ndarray, number: np.ndarray, n: int, span: int) -> tuple[np.ndarray, EliasFano, EliasFano]:
        value = context * span + number
        order = np.argsort(value)
        begins = np.concatenate(([0], np.cumsum(np.bincount(context, minlength=n))))
        return order, EliasFano(value[order], n * span), EliasFano(begins, len(number) + 1)

    def _map(self, *parts: EliasFano | Quantised) -> None:
        owners = [(x, name) for x in parts for name in (x.arrays() if isinstance(x, EliasFano) else ("bins", "means"))]
        for (owner, name), array in zip(owners, mapped([getattr(o, n) for o, n in owners]), strict=True):
            setattr(owner, name, array)

    @staticmethod
    def _find(values: EliasFano, pointers: EliasFano, context: np.ndarray, number: np.ndarray, span: int) -> np.ndarray:
        """Place of each number among the successors of its context, or -1; asked in order and by pieces, which stay in the cache."""
        order = np.argsort(context * span + number)
        begins = pointers.all()
        out = np.full(len(number), -1)
        for at in range(0, len(order) if values.n else 0, _SEARCH):
            rows = order[at : at + _SEARCH]
            below = context[rows]
            out[rows] = values.find_between(begins[below], begins[below + 1], below * span + number[rows])
        return out

    def pair_places(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._find(self.successors, self.pointers, context, word, self.span)

    def log_probability(self, place: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of pairs at the given places, or -1."""
        hit = np.flatnonzero(place >= 0)
        out = self.left.get(context) + self.words.get(word)
        out[hit] = self.pairs.get(place[hit])
        return out

    def log_probability_of_third(self, head: np.ndarray, tail: np.ndarray, shared: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Of w after g h, by the places of the pairs g h and h w, or -1, and the number of h; ``shorter``: with one word of context."""
        out = shorter.copy()
        known = np.flatnonzero(head >= 0)
        out[known] += self.pair_left.get(head[known])
        both = known[tail[known] >= 0]  # what never followed h never followed g h
        number = tail[both] - self.pointers.all()[shared[both]]
        near = number < self.third_span
        both, number = both[near], number[near]
        place = self._find(self.thirds, self.third_pointers, head[both], number, self.third_span)
        hit = np.flatnonzero(place >= 0)
        out[both[hit]] = self.triples.get(place[hit])
        return out


def _score(s: Settings, kind: str):
    schema = pa.schema(
        [("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(part):
            return schema.empty_table()
        found = _tokens(part)
        n = len(found.count)
        answered = _answered(answers, (1, 2, 3))
        counts = {1: answered[1].astype(np.float64), 2: (answered[2] >> np.uint64(s.order > 2)).astype(np.float64)}
        kinds, seen = (answers[c][0].as_py() for c in ("kinds", "tokens"))

        keys, word = found.keys, found.word
        start = len(keys)  # the start of a text is one more context, as frequent as ends are
        of_word = np.append(counts[1], counts[1][np.searchsorted(keys, END)])
        context = np.where(found.first, start, np.roll(word, 1))
        pairs, some, pair = distinct(found.pair)
        _check(answered[1], keys)
        _check(answered[2], pairs)
        p_word = (of_word + s.add) / (seen + s.add * (kinds + 1))
        trained = np.flatnonzero(counts[2] > 0)
        pair_word, pair_context = word[some], context[some]
        whole = of_word + s.strength
        p_pair = (counts[2] + s.strength * p_word[pair_word]) / whole[pair_context]
        trie = Trie(
            start + 1, pair_word[trained], pair_context[trained], np.log10(p_word), np.log10(s.strength / whole), np.log10(p_pair[trained]), s.levels
        )
        place = trie.pair_places(pair_context, pair_word)
        log_pair = trie.log_probability(place, pair_context, pair_word)
        log_token = log_pair[pair]
        if s.order > 2:
            learned = _rows(part, "learned").to_numpy(zero_copy_only=False)[found.row]
            triples = _triples(found, pairs, pair, learned, (answered[2] & np.uint64(1)).astype(bool))
            total = triples.own.astype(np.float64)
            total[triples.open_] = answered[3]
            head, tail = triples.head, triples.tail
            whole = counts[2] + s.triple_strength
            p_triple = (total + s.triple_strength * p_pair[tail]) / whole[head]
            some = np.flatnonzero(total > 0)
            trie.deepen(
                place[head[some]],
                place[tail[some]],
                pair_context[tail[some]],
                np.log10(p_triple[some]),
                place[trained],
                np.log10(s.triple_strength / whole[trained]),
            )
            log_triple = trie.log_probability_of_third(place[head], place[tail], pair_context[tail], log_pair[tail])
            log_token[found.third] = log_triple[triples.number]
        sums = lambda weights: np.bincount(found.row, weights=weights, minlength=n)
        return pa.Table.from_arrays(
            [
                _rows(part, "doc_id"),
                _rows(part, "held_out"),
                pa.array(found.count, pa.int64()),
                pa.array(sums(of_word[word] > 0).astype(np.int64)),
                pa.array(np.full(n, seen), pa.int64()),
                pa.array(sums(np.log10(p_word)[word])),
                pa.array(sums(log_token)),
            ],
            schema=schema,
        )

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return run, ddl


def score_texts(documents: DataFrame, folds: int = 10, held_out: int = 0, s: Settings = Settings()) -> DataFrame:
    """Log10 probability of every text of ``documents`` (``doc_id``, ``text``).

    The model learns from texts outside the held-out fold of crc32(doc_id). Returns ``doc_id``, ``held_out``, ``n_tokens``
    (words and one end), ``n_known``, ``train_tokens``, ``base_score`` (words alone, ``s.add`` added to each count) and
    ``score``. A word w after h has probability (c(hw) + strength * p(w)) / (c(h) + strength), where p is
    the distribution of the base score. With ``s.order`` 3, a word w after g h, where g may be the start of the
    text, has (c(ghw) + triple_strength * p(w | h)) / (c(gh) + triple_strength), where p(w | h) is the former.

    Null and empty texts hold only the end. Rows with a null key are scored, not learned from, and not
    held out. Repeated rows are texts of their own. With nothing to learn from, every word is unknown. An
    empty table gives no rows. Other columns are left out.

    A part is a stretch of the rows of one partition, a shard one of the hash range, so neither depends on how often a word or text
    occurs: a shard gets at most one entry of a word from each part. A part is shuffled once, as its words and their
    numbers in the texts, and used twice, or three times with order 3. Triples are asked for only if both pairs in them were learned
    from and are held by more than one part; otherwise a part's own count is the total. As for every stretch of rows, a task that
    is run again must meet its rows in the same order, as files give them; else ``checkpoint`` the documents.
    """
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = fold(F.col("doc_id"), folds)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = int(size // s.part_bytes + 1)
    dealt = rows.select(
        "doc_id",
        "text",
        F.coalesce(own == held_out, F.lit(False)).alias("held_out"),
        F.coalesce(own != held_out, F.lit(False)).alias("learned"),
    ).mapInArrow(_deal(s.part_bytes), _PART_DDL)
    by_shard = dealt.groupBy("part").applyInArrow(_ask(shards), _ASK_DDL).groupBy("shard")
    answers = by_shard.applyInArrow(_answer(s.order), _ANSWER_DDL)
    # the same shuffle gives the size of the training text, which goes along with every answer
    size = by_shard.applyInArrow(_size, _SIZE_DDL)
    whole = size.agg(F.struct(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).alias("size")).scalar()
    if s.order > 2:
        common = by_shard.applyInArrow(_answer(s.order, only_common=True), _ANSWER_DDL)
        deeper = dealt.groupBy("part").cogroup(common.groupBy("part")).applyInArrow(_ask_triples(shards), _ASK_DDL)
        answers = answers.unionByName(deeper.groupBy("shard").applyInArrow(_answer(s.order), _ANSWER_DDL))
    answers = answers.withColumn("size", whole).select("part", "shard", "level", "totals", "size.kinds", "size.tokens")
    run, ddl = _score(s, pa.int64())
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, ddl)
