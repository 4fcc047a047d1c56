"""Main text of web pages by a tree-structured graphical model.

Every node of a page's block tree is content or not. A node's features speak for either state, and
potentials between parent and child say how the two go together. Messages from the leaves to the root and
back give every node's exact marginal; blocks more likely content than not make up the text.
The weights are fitted by maximum likelihood to labelled pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexloom.llm.htmltree import N_EDGE, N_FEATURES, Forest, Page, forest, levels, parse
from lexloom.llm.labelpages import labelled_pages
from lexloom.llm.words import pieces


@dataclass
class Weights:
    """``node``: features x 2 states. ``edge``: edge features x parent's state x child's state."""

    node: np.ndarray
    edge: np.ndarray


def _plus(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(a, axis=axis)


def marginals(f: Forest, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each state of each node, and of each pair of states of parent and child."""
    own = f.features @ w.node
    pair = np.tensordot(f.edge, w.edge, axes=1)
    nodes = levels(f.depth)
    inside = own.copy()
    up = np.zeros_like(own)
    for at in nodes[:0:-1]:
        up[at] = _plus(pair[at] + inside[at][:, None, :], 2)
        np.add.at(inside, f.parent[at], up[at])
    down = np.zeros_like(own)
    joint = np.zeros_like(pair)
    for at in nodes[1:]:
        parent = f.parent[at]
        outside = inside[parent] + down[parent] - up[at]
        both = outside[:, :, None] + pair[at]
        down[at] = _plus(both, 1)
        joint[at] = both + inside[at][:, None, :]
    total = inside + down
    node = np.exp(total - _plus(total, 1)[:, None])
    linked = f.parent >= 0
    joint[linked] = np.exp(joint[linked] - _plus(_plus(joint[linked], 2), 1)[:, None, None])
    return node, joint


def fit(pages: list[Page], rounds: int = 160, rate: float = 0.15, decay: float = 3e-3) -> Weights:
    """Maximum likelihood by Adam: observed minus expected features, over all pages at once."""
    f = forest(pages)
    state = f.keep.astype(int)
    seen = np.eye(2)[state]
    linked = f.parent >= 0
    seen_pair = np.zeros((len(state), 2, 2))
    seen_pair[np.flatnonzero(linked), state[f.parent[linked]], state[linked]] = 1
    w = Weights(np.zeros((N_FEATURES, 2)), np.zeros((N_EDGE, 2, 2)))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w.node, w.edge)]
    for step in range(1, rounds + 1):
        node, joint = marginals(f, w)
        gradients = (
            f.features.T @ (seen - node) / len(pages) - decay * w.node,
            np.tensordot(f.edge[linked], seen_pair[linked] - joint[linked], axes=([0], [0])) / len(pages) - decay * w.edge,
        )
        for x, g, (m, v) in zip((w.node, w.edge), gradients, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


@cache
def default_weights() -> Weights:
    """Weights fitted to the labelled pages that come with the operator."""
    return fit([parse(html) for html in labelled_pages()])


def main_texts(htmls: list[str | None], w: Weights) -> list[str]:
    pages = [parse(html) for html in htmls]
    f = forest(pages)
    out: list[list[str]] = [[] for _ in pages]
    if len(f.page):
        content = marginals(f, w)[0][:, 1] > 0.5
        texts = [t for p in pages for t in p.text]
        for i in np.flatnonzero(content & f.leaf):
            out[f.page[i]].append(texts[i])
    return ["\n".join(blocks) for blocks in out]


def extract_text(pages: DataFrame, html: str = "html", column: str = "text", weights: Weights | None = None) -> DataFrame:
    """Add the main text of each page: the input's columns, ``column`` and ``n_chars`` (code points).

    Blocks stand in page order, one line each, with character references decoded and white space
    turned into single spaces. Null, empty and markup-only pages give an empty text. Broken markup is
    read as far as it goes. Repeated rows get equal texts. An empty table gives no rows. Columns of those
    names are replaced. ``weights`` default to those fitted to the operator's own labelled pages; ``fit``
    makes others. A page is parsed whole in the task that scans it; nothing is shuffled.
    """
    w = weights or default_weights()
    source = pages.drop(column, "n_chars")
    kept = source.columns
    place = kept.index(html)
    added = [T.StructField(column, T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([*source.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.rename_columns([str(i) for i in range(whole.num_columns)])
            for batch in pieces(whole, str(place), 1 << 20):
                texts = main_texts(batch.column(place).to_pylist(), w)
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), sizes], [*kept, column, "n_chars"])

    return source.mapInArrow(run, schema)
