"""Spelling variants: words one edit apart, found by walking tries that are tables of edges.

Words of one length form a trie. A word is looked up in the trie of its own length, where one letter
may be replaced, and in the trie of words one letter longer, where one may be inserted; so every pair of near words is
found from its shorter or smaller word. An edit in the second half of a word leaves the first half alone, so the walk starts
at the node of that half; edits in the first half are found in the same way from the words written backwards. Hence no walk
begins at the root, where all would meet. Nodes without a choice are left out: an edge holds all letters up to
the next node.

A frontier of states (word, what is left of it, node, edits) is joined with the edges round by round until none is left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.storage import stored
from lexloom.llm.words import Words, mix, text_buffers

RUN = re.compile("[a-zÀ-ÿ]+")
FLUSH_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    """Words need ``least_length`` code points and ``least_count`` occurrences; a form is at least ``times`` as frequent
    as its variant. Of runs whose checksum is divisible by ``damage_one_in`` one code point is deleted."""

    least_length: int = 7
    least_count: int = 2
    times: int = 10
    damage_one_in: int = 31


def _word_counts(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                found = Counter(RUN.findall((text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                name = key.as_py()
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in found.items():
                    if len(word) < settings.least_length:
                        continue
                    checksum = zlib.crc32(word.encode(), start)
                    if checksum % settings.damage_one_in == 0:
                        gone = checksum % len(word)
                        word = word[:gone] + word[gone + 1 :]
                        if len(word) < settings.least_length:
                            continue
                    counts[word] += n
                if len(counts) >= FLUSH_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def count_words(documents: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """``word``, ``n`` of the words that are long and frequent enough."""
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    counted = rows.mapInArrow(_word_counts(settings), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= settings.least_count)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of each word from where the first walk may start: ``id``, ``pos``, ``node``, ``next``, ``start``.

    ``next`` tells the next letters apart; ``start`` marks the places where walks begin. Nodes are 64-bit hashes of the prefix, the
    length and the direction. Two prefixes with one hash would only add edges to a node: what a walk accepts is compared letter by
    letter, save the prefix it starts from, which the last check of a pair covers.
    """
    for batch in batches:
        data, offsets = text_buffers(batch.column("word"))
        heads = (data & 0xC0) != 0x80
        letter = np.flatnonzero(heads)
        row = np.searchsorted(offsets, letter, side="right") - 1
        length = np.bincount(row, minlength=batch.num_rows)
        pos = np.arange(len(letter)) - (np.cumsum(length) - length)[row]
        backward = np.asarray(batch.column("backward").to_numpy(zero_copy_only=False)).astype(np.int64)[row]
        later = (length[row] + backward) // 2  # where walks of words of this length start
        early = (length[row] - 1 + backward) // 2  # and of words one shorter
        wanted = pos >= early
        letter, row, pos = letter[wanted], row[wanted], pos[wanted]
        starts = (pos == early[wanted]) | (pos == later[wanted])
        ends = np.append(np.flatnonzero(heads), len(data))
        after = ends[np.searchsorted(ends, letter, side="right")]
        tag = mix((length[row] * 2 + backward[wanted]).astype(np.uint64) + np.uint64(1))
        words = Words(data, offsets, row, offsets[row], letter, batch.num_rows)
        node = mix(words.hashes() + tag).view(np.int64)
        longer = Words(data, offsets, row, offsets[row], after, batch.num_rows)
        following = mix(longer.hashes() + tag).view(np.int64)
        ids = np.asarray(batch.column("id"))[row]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(pos, pa.int32()), pa.array(node), pa.array(following), pa.array(starts)],
            ["id", "pos", "node", "next", "start"],
        )


def _edges(words: DataFrame) -> DataFrame:
    """Edges of all tries: ``node``, ``label``, ``size`` of the label, and ``child``, or ``target`` where a word ends."""
    places = stored(words.select("id", "word", "backward").mapInArrow(_places, "id long, pos int, node long, next long, start boolean"), "places")
    forks = places.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"), F.max("start").alias("start"))
    forks = forks.where((F.col("low") < F.col("high")) & ~F.col("start")).select("node")
    inner = places.where("not start").join(forks, "node", "left_semi").select("id", "pos", "node")
    kept = inner.union(places.where("start").select("id", "pos", "node"))
    step = F.struct("pos", "node")
    paths = kept.groupBy("id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    pairs = F.transform(
        F.col("steps"),
        lambda s, i: F.struct(
            s["node"].alias("node"), s["pos"].alias("pos"), F.get("steps", i + 1)["pos"].alias("to"), F.get("steps", i + 1)["node"].alias("child")
        ),
    )
    path = paths.join(words.select("id", "word", "length"), "id")
    edge = path.select("id", "word", "length", F.explode(pairs).alias("e"))
    to = F.coalesce(F.col("e.to"), F.col("length"))
    cut = edge.select(
        F.col("e.node").alias("node"),
        F.substr("word", F.col("e.pos") + 1, to - F.col("e.pos")).alias("label"),
        F.col("e.child").alias("child"),
        F.when(F.col("e.child").isNull(), F.col("id")).alias("target"),
    )
    return cut.distinct().withColumn("size", F.char_length("label"))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States after one more edge; those with a ``target`` have reached a word by one edit."""
    left, label, size = F.col("rest"), F.col("label"), F.col("size")
    same = F.startswith(left, label)
    inserting = F.col("inserting")
    beside = F.when(inserting, F.substr(left, F.lit(1), size - 1)).otherwise(F.substr(left, F.lit(1), size))
    edited = (F.col("edits") == 0) & ~same & (F.levenshtein(label, beside, 1) == 1) & (inserting | (label > beside))
    used = F.when(edited & inserting, size - 1).otherwise(size)
    after = states.join(edges, "node").where(same | edited)
    edits = F.when(same, F.col("edits")).otherwise(1)
    after = after.select("id", "inserting", edits.alias("edits"), F.substr(left, used + 1, F.char_length(left)).alias("rest"), F.col("child").alias("node"), "target")
    return after.where(F.col("node").isNotNull() | (F.col("edits") == 1))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, both ways round: ``word``, ``n``, ``near``, ``near_n``."""
    numbered = stored(words.withColumn("number", F.monotonically_increasing_id()), "words")
    ways = F.explode(F.array(F.lit(0), F.lit(1))).alias("backward")
    both = numbered.select("number", "word", "n", ways)
    both = both.select(
        (F.col("number") * 2 + F.col("backward")).alias("id"),
        F.when(F.col("backward") == 1, F.reverse("word")).otherwise(F.col("word")).alias("word"),
        "backward",
        F.char_length("word").alias("length"),
    )
    edges = stored(_edges(both), "edges")

    # A walk starts behind the half that stays as it is; its node's hash is made by the same code as the trie's.
    begins = both.mapInArrow(_begins, "id long, inserting boolean, node long, rest string")
    states = begins.select("id", "inserting", F.lit(0).alias("edits"), "rest", "node", F.lit(None).cast("long").alias("target"))
    hits, frontier = [], states
    while True:
        moved = stored(_step(frontier.drop("target"), edges), "frontier")
        hits.append(moved.where("target is not null").select("id", "target"))
        frontier = moved.where("target is null")
        if frontier.isEmpty():
            break
    found = hits[0]
    for more in hits[1:]:
        found = found.union(more)
    found = found.select(F.expr("id div 2").alias("a"), F.expr("target div 2").alias("b"), (F.col("id") % 2 == 1).alias("backward"))
    as_a = numbered.select(F.col("number").alias("a"), F.col("word").alias("word"), F.col("n").alias("n"))
    as_b = numbered.select(F.col("number").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    named = found.join(as_a, "a").join(as_b, "b")
    half = F.expr("char_length(word) div 2")
    forward_too = F.substr("word", F.lit(1), half) == F.substr("near", F.lit(1), half)
    named = named.where((F.levenshtein("word", "near", 1) == 1) & ~(F.col("backward") & forward_too))
    named = stored(named.select("word", "n", "near", "near_n"), "near")
    return named.union(named.select("near", "near_n", "word", "n"))


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("word"))
        letter = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        backward = np.asarray(batch.column("backward")).astype(np.int64)
        length = np.asarray(batch.column("length")).astype(np.int64)
        half = (length + backward) // 2
        cut = letter[np.cumsum(length) - length + half]
        rows = np.arange(batch.num_rows)
        hashes = Words(data, offsets, rows, offsets[:-1], cut, batch.num_rows).hashes()
        rest = [bytes(data[a:b]).decode() for a, b in zip(cut, offsets[1:], strict=True)]
        for inserting in (False, True):
            tag = mix(((length + inserting) * 2 + backward).astype(np.uint64) + np.uint64(1))
            node = mix(hashes + tag).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.full(len(rows), inserting)), pa.array(node), pa.array(rest, pa.string())],
                ["id", "inserting", "node", "rest"],
            )


def _roots(forms: DataFrame) -> DataFrame:
    """The last form of each chain of ``word``, ``form``; every round doubles the steps taken. A form is more frequent than
    its variant by a factor, so chains cannot close and are short."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = stored(moved, "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def group_spellings(documents: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Every word of the texts with its near words counted and its more frequent spelling.

    Returns ``word``, ``form`` (the most frequent near word, the smaller of equals, if it is ``times`` as frequent; else null),
    ``root`` (the last of the chain of forms, the word itself without one), ``n``, ``n_near``, ``form_n``.

    Null and empty texts hold no words. Repeated rows count as often as they stand there. A null key takes part as an empty one.
    Very long words are words like others: their walks take as many rounds as other words branch off them. Other columns
    are left out, so their names cannot clash. An empty table gives no rows.
    """
    words = stored(count_words(documents, key, text, settings), "counts")
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    frequent = -F.col("best.less") >= settings.times * F.col("n")
    judged = joined.select(
        "word",
        F.when(frequent, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    judged = stored(judged, "judged")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
