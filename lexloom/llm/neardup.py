"""Near-duplicates by bottom-k sketches from one hash function.

A text's set holds its distinct word shingles. Its sketch is the ``k`` smallest hashes of the
set. Two linked sets (Jaccard similarity 0.75 or more) share at least ``need`` values of their sketches: all
sets small enough to be whole in the sketch exactly, others but for six standard deviations. With 64 values and a
similarity of exactly 0.75 the binomial law puts 2.5e-8 below that, 25 pairs in a billion; more similar pairs miss less
often. So they also share one of the ``k - need + 1`` values of each sketch that are
rarest in the corpus. The inverted lists of those values give the candidates: a passage that many
texts hold is no candidate unless it makes up most of them. The sketches of both sides, merged, estimate
the similarity and drop pairs six standard deviations below the limit; the sets themselves decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.components import components
from lexloom.llm.storage import stored
from lexloom.llm.words import mix, pieces, split_words

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; linked if 100 * intersection >= ``percent`` * union."""

    width: int = 5
    percent: int = 75
    k: int = 64
    short_list: int = 48

    def listed(self, n: Column) -> Column:
        """How many of the rarest values of the sketch of a set of ``n`` are listed.

        Up to percent / 100 * k both sets of a linked pair are whole in their sketches.
        """
        size = F.least(n, F.lit(self.k))
        s = self.percent / 100
        likely = F.ceil(F.lit(s) * size - 6 * F.sqrt(F.lit(s * (1 - s)) * size))
        exact = F.ceil(size * self.percent / 100)
        need = F.when(100 * n <= self.percent * self.k, exact).otherwise(F.greatest(likely, F.lit(1)))
        return (size - need + 1).cast("int")


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by row and hash."""
    words = split_words(texts)
    count, n = words.counts(), len(words.row)
    row_end = np.cumsum(count)[words.row] if n else words.row
    each = words.hashes()
    spread = np.uint64(0x9E3779B97F4A7C15)
    full = np.flatnonzero(np.arange(n) + width <= row_end)
    value = np.full(len(full), width, np.uint64)
    for step in range(width):
        value = mix(value * spread + each[full + step])
    short = np.flatnonzero((count > 0) & (count < width))
    firsts = words.firsts()
    rest = np.array(count[short], np.uint64)
    for step in range(width - 1):
        there = count[short] > step
        rest[there] = mix(rest[there] * spread + each[firsts[short[there]] + step])
    row, value = np.concatenate((words.row[full], short)), np.concatenate((value, rest)) >> np.uint64(1)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1]))) if len(row) else np.zeros(0, bool)
    return row[new], value[new]


def _sketch(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                row, value = shingle_hashes(batch.column(1), rule.width)
                n = np.bincount(row, minlength=batch.num_rows)
                first = np.concatenate(([0], np.cumsum(n)))
                marks = [np.zeros(batch.num_rows, np.uint64) for _ in range(2)]
                for mark, salt in zip(marks, (0, 0x5851F42D4C957F2D), strict=True):
                    filled = n > 0
                    if filled.any():
                        mark[filled] = np.add.reduceat(mix(value ^ np.uint64(salt)), first[:-1][filled])
                low = np.minimum(n, rule.k)
                offsets = np.concatenate(([0], np.cumsum(low)))
                taken = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], low)
                sketch = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(value[taken].view(np.int64), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), *(pa.array(m.view(np.int64)) for m in marks), sketch],
                    ["id", "n", "mark_a", "mark_b", "sketch"],
                )

    return run


def sketches(documents: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """``id``, ``n`` (distinct shingles), two 64-bit sums that identify the set, and the sketch of each row."""
    rows = documents.select(documents[key].cast("long").alias("id"), documents[text].alias("text"))
    return rows.mapInArrow(_sketch(rule), "id long, n long, mark_a long, mark_b long, sketch array<long>")


_MARKS = ["n", "mark_a", "mark_b"]


def _similar_size(a: str, b: str, rule: Rule) -> Column:
    return 100 * F.least(a, b) >= rule.percent * F.greatest(a, b)


def _estimate(rule: Rule):
    s = rule.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("sketch_a", "sketch_b")]
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), np.asarray(x.value_lengths())) for x in lists])
            value = np.concatenate([x.flatten().to_numpy() for x in lists])
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            again = np.concatenate(([False], (row[1:] == row[:-1]) & (value[1:] == value[:-1])))[: len(row)]
            kinds = np.cumsum(~again) - 1
            first = np.concatenate(([0], np.cumsum(np.bincount(row[~again], minlength=batch.num_rows))))
            whole = (batch.column("n_a").to_numpy() <= rule.k) & (batch.column("n_b").to_numpy() <= rule.k)
            low = whole[row] | (kinds - first[row] < rule.k)
            size = np.where(whole, np.diff(first), np.minimum(np.diff(first), rule.k))
            common = np.bincount(row[again & low], minlength=batch.num_rows)
            slack = np.where(whole, 0.0, 6 * np.sqrt(s * (1 - s) * size))
            likely = pa.array(common + slack + 1e-9 >= s * size)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(likely) for c in ("a", "b")], ["a", "b"])

    return run


def _likely(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose merged sketches leave a link possible. The ``k`` smallest values of both sketches together
    are a sketch of the union; for sets that are whole in their sketches all values count."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(_similar_size("n_a", "n_b", rule))
    return joined.mapInArrow(_estimate(rule), "a long, b long").distinct()


def shingle_set(text: str | None, width: int) -> frozenset[tuple[str, ...]]:
    words = _WORD.findall((text or "").translate(_LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(width)), strict=False))


def _confirm(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_sets = None, []
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                a, _, b, text = (batch.column(i)[at].as_py() for i in range(4))
                own = shingle_set(text, rule.width)
                if a != hub:
                    hub, hub_sets = a, []
                if b is None:
                    hub_sets.append(own)
                    continue
                for other in hub_sets:
                    common = len(own & other)
                    if 100 * common >= rule.percent * (len(own) + len(other) - common):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=_LINK)

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MEMBERS_PER_HUB_COPY = 64


def _confirmed(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose whole sets meet the limit.

    The texts of the pairs' second sides travel to the first sides. A first side in many pairs is
    sent once for about every ``MEMBERS_PER_HUB_COPY`` of them, so neither its text is multiplied by its
    partners nor do they all meet in one task.
    """
    pairs = stored(pairs, "pairs")
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_PER_HUB_COPY).cast("int").alias("parts"))
    load = stored(load, "pairs")
    salted = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    member = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
    hub = load.join(texts.withColumnRenamed("id", "a"), "a")
    hub = hub.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    rows = hub.unionByName(member).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return stored(rows.mapInArrow(_confirm(rule), "a long, b long"), "links")


def _inverted(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Entries of the inverted lists that hold two sets or more, each with its list's length and hub.

    A set is listed under the rarest values of its sketch. Values that no other sketch has are the
    rarest of all and need no list. The hub of a list is the set whose values have the longest
    lists: in a family of edited copies that is the text they were made from, as each edit
    brings values that no other has.
    """
    values = nodes.select("id", "n", F.explode("sketch").alias("value"))
    known = stored(values.groupBy("value").agg(F.count("*").alias("known")).where("known > 1"), "lists")
    shared = values.join(known, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("known", "value"))).alias("shared"))
    alone = F.least(F.col("n"), F.lit(rule.k)).cast("int") - F.size("shared")
    listed = F.slice("shared", 1, F.greatest(rule.listed(F.col("n")) - alone, F.lit(0)))
    entries = stored(shared.select("id", "n", F.explode(F.transform(listed, lambda x: x["value"])).alias("value")), "lists")
    length = stored(entries.groupBy("value").agg(F.count("*").alias("length")).where("length > 1"), "lists")
    entries = stored(entries.join(length, "value"), "lists")
    weight = stored(entries.groupBy("id").agg(F.sum("length").alias("weight")), "lists")
    weighed = entries.join(weight, "id")
    hub = weighed.groupBy("value").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"), "n")).alias("top"))
    hub = stored(hub.select("value", (-F.col("top.id")).alias("hub"), F.col("top.n").alias("hub_n")), "lists")
    return stored(entries.join(hub, "value"), "lists")


def _split_lists(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of lists that still hold more than one component, with the component of each set."""
    placed = entries.join(labels.withColumnRenamed("node", "id"), "id", "left")
    placed = stored(placed.withColumn("component", F.coalesce("component", "id")), "lists")
    mixed = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = stored(mixed.where("low < high").select("value"), "lists")
    return stored(placed.join(mixed, "value"), "lists")


def _pairs_in_short_lists(entries: DataFrame, rule: Rule) -> DataFrame:
    """Pairs from different components within lists of bounded length; the hub's pairs are known."""
    short = entries.where((F.col("length") <= rule.short_list) & (F.col("id") != F.col("hub")))
    side = lambda c: short.select("value", F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("component").alias(f"of_{c}"))
    met = side("a").join(side("b"), "value").where("a < b and of_a <> of_b").where(_similar_size("n_a", "n_b", rule))
    return met.select("a", "b")


def _whole_sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                row, value = shingle_hashes(batch.column("text"), rule.width)
                offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], [*batch.schema.names[:-1], "values"])

    return run


def _pairs_in_blocks(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for at in range(batch.num_rows):
                found |= _block_links(*(batch.column(i)[at].values for i in (0, 1)), rule)
            pairs = sorted(found)
            yield pa.RecordBatch.from_pydict({"a": [x[0] for x in pairs], "b": [x[1] for x in pairs]}, schema=_LINK)

    return run


CELLS = 4_000_000


def _block_links(left: pa.StructArray, right: pa.StructArray, rule: Rule) -> set[tuple[int, int]]:
    """Similar sets of different components in two blocks; per left set one of each other component.

    A few left sets at a time are laid out over the values they hold, and the values of the right
    sets that meet them are added up set by set.
    """
    (id_a, of_a), (id_b, of_b) = ([x.field(f).to_numpy() for f in ("id", "component")] for x in (left, right))
    sets = [x.field("values") for x in (left, right)]
    size_a, size_b = (np.asarray(x.value_lengths(), dtype=np.int64) for x in sets)
    values_a, values_b = (x.flatten().to_numpy() for x in sets)
    first_a = np.concatenate(([0], np.cumsum(size_a)))
    row_b = np.repeat(np.arange(len(right)), size_b)
    height = int(max(1, min(64, (CELLS / max(1, size_a.max(initial=1))) ** 0.5)))
    found: set[tuple[int, int]] = set()
    for top in range(0, len(left), height):
        end = min(top + height, len(left))
        known, number = np.unique(values_a[first_a[top] : first_a[end]], return_inverse=True)
        table = np.zeros((end - top, len(known)), np.float32)
        table[np.repeat(np.arange(end - top), size_a[top:end]), number] = 1
        place = np.minimum(np.searchsorted(known, values_b), len(known) - 1)
        hit = np.flatnonzero(known[place] == values_b)
        common = np.zeros((end - top, len(right)))
        for part in np.array_split(hit, max(1, len(hit) * (end - top) // CELLS)):
            if len(part):
                rows, starts = np.unique(row_b[part], return_index=True)
                common[:, rows] += np.add.reduceat(table[:, place[part]], starts, axis=1)
        union = size_a[top:end, None] + size_b - common
        linked = (100 * common >= rule.percent * union) & (of_a[top:end, None] != of_b)
        seen: set[tuple[int, int]] = set()
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b, other = int(id_a[top + i]), int(id_b[j]), int(of_b[j])
            if (a, other) not in seen:
                seen.add((a, other))
                found.add((min(a, b), max(a, b)))
    return found


BLOCK_VALUES = 250_000


def _pairs_in_long_lists(entries: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links between different components of the sets that share a long list, by their whole sets.

    Lists of one hub are taken together. In each such group the largest component is set aside: its members need no
    comparison with one another, only with the others, and those are compared with all. Both
    sides are dealt into blocks of bounded size and each pair of blocks is one row of work,
    so no group gathers in a task and only links become rows.
    """
    long_ = entries.where(F.col("length") > rule.short_list).select("hub", "id", "n", "component").distinct()
    long_ = stored(long_, "groups")
    size = long_.groupBy("hub", "component").agg(F.count("*").alias("size"), F.sum("n").alias("values"))
    largest = size.groupBy("hub").agg(F.max(F.struct("size", "component", "values")).alias("top"), F.sum("values").alias("total"))
    largest = stored(
        largest.select(
            "hub",
            F.col("top.component").alias("main"),
            F.ceil((F.col("total") - F.col("top.values")) / BLOCK_VALUES).cast("int").alias("parts_a"),
            F.ceil(F.col("total") / BLOCK_VALUES).cast("int").alias("parts_b"),
        ).where("parts_a > 0"),
        "groups",
    )
    members = stored(long_.join(largest, "hub"), "groups")
    known = members.join(texts, "id").select("hub", "main", "parts_a", "parts_b", "id", "component", "text")
    kind = "hub long, main long, parts_a int, parts_b int, id long, component long, values array<long>"
    rows = stored(known.mapInArrow(_whole_sets(rule), kind), "sets")
    item = F.struct("id", "component", "values").alias("item")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = rows.where("component <> main").select("hub", part("parts_a").alias("part_a"), item)
    left = left.groupBy("hub", "part_a").agg(F.collect_list("item").alias("left"))
    right = rows.select("hub", part("parts_b").alias("part_b"), "parts_a", item)
    right = stored(right.groupBy("hub", "part_b", "parts_a").agg(F.collect_list("item").alias("right")), "groups")
    right = right.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
    met = stored(left, "groups").join(right, ["hub", "part_a"]).select("left", "right")
    return met.mapInArrow(_pairs_in_blocks(rule), "a long, b long")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()
) -> DataFrame:
    """Component of every row in the graph of near-duplicate texts.

    Returns ``id`` (the key as long), ``n_shingles``, ``component_id`` (the smallest key reachable)
    and ``kept`` (the row's key is that smallest one).

    1. Rows with the same set, told by its size and two sums of 64 bits, become one node.
    2. In every inverted list each set is compared with the list's hub; confirmed links
       give components. 3. Lists that still hold several components are compared
       across them: pair by pair up to ``rule.short_list`` sets, in blocks beyond. So all
       pairs that share a listed value are either in one component or compared.

    Null and empty texts have no shingles and stay alone. A null key takes no part, has
    a null component and is kept. Rows that share a key are one document. Ties and repeated
    rows: equal sets form one component. An empty table gives no rows. Other columns are left out.
    """
    rows = stored(sketches(documents, key, text, rule), "sketches")
    filled = rows.where("n > 0 and id is not null")
    classes = stored(filled.groupBy(*_MARKS).agg(F.min("id").alias("node")), "classes")
    own = [rows[m] == classes[m] for m in _MARKS]
    nodes = stored(rows.join(classes, [*own, rows["id"] == classes["node"]], "left_semi").select("id", "n", "sketch").distinct(), "nodes")
    texts = documents.select(documents[key].cast("long").alias("id"), documents[text].alias("text"))

    entries = _inverted(nodes, rule)
    near_hub = entries.where((F.col("id") != F.col("hub"))).where(_similar_size("n", "hub_n", rule))
    pairs = near_hub.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(_likely(pairs, nodes, rule), texts, rule)
    labels = components(links)
    apart = _split_lists(entries, labels)
    more = _pairs_in_short_lists(apart, rule).union(_pairs_in_long_lists(apart, texts, rule)).distinct()
    more_links = _confirmed(_likely(more, nodes, rule), texts, rule)
    if more_links.limit(1).count():
        labels = components(links.union(more_links))

    named = rows.select("id", *_MARKS).join(classes, _MARKS, "left").withColumn("node", F.coalesce("node", "id"))
    placed = named.join(labels, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    result = placed.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
