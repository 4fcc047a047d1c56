"""SentencePiece encoding and decoding.

Encoding finds the segmentation of greatest total score: an Aho-Corasick automaton over the bytes
of the pieces reads each word once, and at every position the output links name the pieces that end
there, each of which may raise the best score. Words of a batch are handled side by side, one byte
position at a time. Pieces never cross the start of a word, so each distinct word is
segmented once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexloom.llm.words import Words, pieces as slices, text_buffers

SPACE = "▁"


@dataclass
class Vocabulary:
    """Bytes and score of each piece; ``byte_ids`` are the pieces that stand for single bytes.

    In the stored bytes a space takes the place of the mark that begins words. Only ``matched`` pieces
    take part in the automaton: control pieces and byte pieces do not.
    """

    surfaces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    matched: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a SentencePiece model file that has byte pieces.

        Models of merge rules store minus the rank of a piece as its score, which adds up to
        nothing meaningful over a segmentation. There a piece of rank r gets the log
        probability of Zipf's law, -log(r + 2), instead; scores of unigram models are kept.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        byte = np.array([model.is_byte(i) for i in range(n)])
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids = np.full(256, -1)
        for i in np.flatnonzero(byte):
            byte_ids[int(names[i][3:-1], 16)] = i
        if (byte_ids < 0).any():
            raise ValueError("the model has no piece for some bytes")
        surfaces = [
            b"" if special[i] else bytes([int(names[i][3:-1], 16)]) if byte[i] else names[i].replace(SPACE, " ").encode()
            for i in range(n)
        ]
        scores = np.array([model.get_score(i) for i in range(n)])
        usable = ~special & ~byte
        if usable.any() and np.array_equal(scores[usable], np.round(scores[usable])):
            scores = -np.log(2 - np.minimum(scores, 0))
        # a piece with a space after another character would cross the start of a word
        inner = np.array([b" " in s.lstrip(b" ") for s in surfaces])
        return cls(surfaces, scores, byte_ids, np.flatnonzero(usable & ~inner))


class Automaton:
    """Goto, failure and output links of the pieces, in arrays.

    ``child`` maps state * 256 + byte (sorted) to the next state. ``piece`` is the piece that
    ends in a state, or -1; ``link`` the longest proper suffix state at which a piece ends.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        words = [vocabulary.surfaces[i] for i in vocabulary.matched]
        state = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words])
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(lengths)[:-1]))
        edges, targets, total, depth_states = [], [], 1, [np.zeros(1, np.int64)]
        for depth in range(lengths.max(initial=0)):
            live = np.flatnonzero(lengths > depth)
            key = state[live] * 256 + data[starts[live] + depth]
            new, number = np.unique(key, return_inverse=True)
            state[live] = total + number
            edges.append(new)
            targets.append(total + np.arange(len(new)))
            depth_states.append(targets[-1])
            total += len(new)
        self.edges, self.targets = np.concatenate(edges), np.concatenate(targets)
        order = np.argsort(self.edges)
        self.edges, self.targets = self.edges[order], self.targets[order]
        self.root = np.zeros(256, np.int64)
        first = self.edges < 256
        self.root[self.edges[first]] = self.targets[first]
        self.piece = np.full(total, -1)
        self.piece[state] = vocabulary.matched
        self.fail, self.link = np.zeros(total, np.int64), np.zeros(total, np.int64)
        parent, byte = np.zeros(total, np.int64), np.zeros(total, np.int64)
        parent[self.targets], byte[self.targets] = self.edges // 256, self.edges % 256
        for states in depth_states[1:]:
            deep = states[parent[states] != 0]
            self.fail[deep] = self.step(self.fail[parent[deep]], byte[deep])
            self.link[states] = np.where(self.piece[self.fail[states]] >= 0, self.fail[states], self.link[self.fail[states]])
        self.length = np.array([len(s) for s in vocabulary.surfaces])
        self.byte_score = vocabulary.scores[vocabulary.matched].min(initial=0.0) - 10.0

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next state of each pair, falling back along failure links."""
        out = np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        state = state.copy()
        while len(open_):
            at_root = state[open_] == 0
            out[open_[at_root]] = self.root[byte[open_[at_root]]]
            open_ = open_[~at_root]
            key = state[open_] * 256 + byte[open_]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[place] == key
            out[open_[hit]] = self.targets[place[hit]]
            open_ = open_[~hit]
            state[open_] = self.fail[state[open_]]
        return out

    def segment(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of each word ``data[start:end]``: number of pieces per word, and all pieces in order.

        A byte can always be written as its byte piece, ``byte_score`` below any other. Among
        equal totals the longest last piece wins.
        """
        n = len(start)
        length = end - start
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        offset = np.concatenate(([0], np.cumsum(length + 1)))
        best = np.full(offset[-1], -np.inf)
        last = np.zeros(offset[-1], np.int64)
        base = offset[:-1]
        best[base] = 0.0
        state = np.zeros(n, np.int64)
        scores = self.vocabulary.scores
        for at in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -at, side="left"))  # words longer than ``at``
            byte = data[start[:live] + at].astype(np.int64)
            state = self.step(state[:live], byte)
            value, choice = np.full(live, -np.inf), np.zeros(live, np.int64)
            row, visit = np.arange(live), np.where(self.piece[state] >= 0, state, self.link[state])
            while len(row := row[visit > 0]):
                visit = visit[visit > 0]
                piece = self.piece[visit]
                total = best[base[row] + at + 1 - self.length[piece]] + scores[piece]
                better = total > value[row]
                value[row[better]], choice[row[better]] = total[better], piece[better]
                visit = self.link[visit]
            single = best[base[:live] + at] + self.byte_score
            plain = single > value
            value[plain], choice[plain] = single[plain], self.vocabulary.byte_ids[byte[plain]]
            best[base[:live] + at + 1], last[base[:live] + at + 1] = value, choice
        # walk back from the ends, all words at once
        place, steps, open_ = length.copy(), [], np.flatnonzero(length > 0)
        while len(open_):
            piece = last[base[open_] + place[open_]]
            steps.append((open_, piece))
            place[open_] -= self.length[piece]
            open_ = open_[place[open_] > 0]
        row = np.concatenate([r for r, _ in steps]) if steps else np.zeros(0, np.int64)
        found = np.concatenate([p for _, p in steps]) if steps else row
        back = np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps]) if steps else row
        original = order[row]
        by = np.lexsort((-back, original))
        return np.bincount(original, minlength=n), found[by]


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first[i], first[i] + 1, ... of count[i] entries each, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def encode(texts: pa.Array, automaton: Automaton) -> pa.ListArray:
    """Piece numbers of each text. A word begins at a run of spaces or at the start of the text."""
    data, offsets = text_buffers(texts)
    space = data == 32
    begins = np.concatenate(([True], space[1:] & ~space[:-1])) if len(data) else space
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data)) if len(start) else start
    row = np.searchsorted(offsets, start, side="right") - 1
    words = Words(data, offsets, row, start, end, len(texts))
    kind, number = np.unique(words.hashes(), return_index=True, return_inverse=True)[1:]
    count, found = automaton.segment(data, start[kind], end[kind])
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    ids = found[_ragged(first[number], count[number])] if len(number) else found
    per_text = np.bincount(row, weights=count[number], minlength=len(texts)).astype(np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32()), pa.array(ids.astype(np.int32))
    )


def decode(ids: pa.ListArray, vocabulary: Vocabulary) -> pa.Array:
    """The texts that the piece numbers spell."""
    lengths = np.array([len(s) for s in vocabulary.surfaces])
    table, first = np.frombuffer(b"".join(vocabulary.surfaces), np.uint8), np.concatenate(([0], np.cumsum(lengths)[:-1]))
    flat = ids.flatten().to_numpy()
    size = lengths[flat]
    data = table[_ragged(first[flat], size)]
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths()))))]
    return pa.Array.from_buffers(
        pa.large_string(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())]
    )


_automata: dict[str, Automaton] = {}


def automaton_of(path: str) -> Automaton:
    """The automaton of a model file, built once per process. Operators build it on the driver and send its arrays to the tasks."""
    if path not in _automata:
        _automata[path] = Automaton(Vocabulary.load(path))
    return _automata[path]


SLICE_BYTES = 512 << 10
SLICE_PIECES = 128 << 10


def encode_pieces(documents: DataFrame, model: str, text: str = "text", column: str = "pieces") -> DataFrame:
    """Add the piece numbers of each text: the input's columns and ``column`` (array<int>).

    ``model`` is the path of a SentencePiece model file, read on the driver. Nothing is normalised, and
    every byte has a piece, so decoding gives back each text byte for byte. Null and empty texts have no
    pieces. Repeated rows get equal pieces. An empty table gives no rows. A column of that name is replaced. Texts are
    encoded whole in the task that scans them, about ``SLICE_BYTES`` at a time; nothing is shuffled.
    """
    sent = documents.sparkSession.sparkContext.broadcast(automaton_of(model))
    added = [T.StructField(column, T.ArrayType(T.IntegerType()))]
    return _mapped(documents, text, added, lambda texts: [encode(texts, sent.value)], _text_slices)


def decode_pieces(encoded: DataFrame, model: str, pieces: str = "pieces", column: str = "decoded") -> DataFrame:
    """Add the text that the piece numbers spell; null is empty. A column of that name is replaced. Rows are decoded
    about ``SLICE_PIECES`` pieces at a time; a longer one alone."""
    sent = encoded.sparkSession.sparkContext.broadcast(automaton_of(model).vocabulary)
    added = [T.StructField(column, T.StringType())]
    return _mapped(encoded, pieces, added, lambda ids: [_decoded(ids, sent.value).cast(pa.string())], _piece_slices)


def encode_and_check(
    documents: DataFrame, model: str, text: str = "text", column: str = "pieces", check: str = "round_trip"
) -> DataFrame:
    """As :func:`encode_pieces`, with a column that says whether the pieces decode to the text, byte for byte (null: empty).

    Both are done in one pass, so that a core runs one Python process and a text crosses to it once.
    """
    sent = documents.sparkSession.sparkContext.broadcast(automaton_of(model))

    def both(texts: pa.Array) -> list[pa.Array]:
        ids = encode(texts, sent.value)
        same = pc.equal(_decoded(ids, sent.value.vocabulary), pc.fill_null(texts, "").cast(pa.large_string()))
        return [ids, same]

    added = [T.StructField(column, T.ArrayType(T.IntegerType())), T.StructField(check, T.BooleanType())]
    return _mapped(documents, text, added, both, _text_slices)


def _decoded(ids: pa.ListArray, vocabulary: Vocabulary) -> pa.Array:
    return decode(ids.fill_null([]) if ids.null_count else ids, vocabulary)


def _text_slices(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    return slices(batch, str(place), SLICE_BYTES)


def _piece_slices(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(place)), 0), np.int64)
    part = np.cumsum(sizes) // SLICE_PIECES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        if begin < end:
            yield batch.slice(begin, end - begin)


def _mapped(frame: DataFrame, source: str, added: list[T.StructField], make, parts) -> DataFrame:
    names = [field.name for field in added]
    rows = frame.drop(*names)
    kept = rows.columns
    place = kept.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.rename_columns([str(i) for i in range(whole.num_columns)])
            for batch in parts(whole, place):
                yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(place))], [*kept, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))
