"""Cleaning, previewing and packing of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a Unicode-aware strip removes, as one string.
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ELLIPSIS = "…"


def flatten_line_breaks(text: Column) -> Column:
    """Each CRLF, CR or LF becomes one space; runs are not collapsed.

    Plain replacements cost little where a filter on the result makes Catalyst
    evaluate it twice.
    """
    for line_break in ("\r\n", "\r", "\n"):
        text = F.replace(text, F.lit(line_break), F.lit(" "))
    return text


def strip(text: Column) -> Column:
    """Remove every kind of Unicode space at both ends.

    ``F.trim`` alone takes off the plain space only.
    """
    return F.btrim(text, F.lit(UNICODE_SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def preview(text: Column, n_chars: int) -> Column:
    """The first ``n_chars`` characters and an ellipsis, added even when nothing was cut."""
    return F.concat(F.left(F.coalesce(text, F.lit("")), F.lit(n_chars)), F.lit(ELLIPSIS))


def show_cell(text: Column, width: int = 80) -> Column:
    """A value cut the way ``DataFrame.show(truncate=width)`` cuts it."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)


def similarity_label(similarity: Column) -> Column:
    return F.format_string("%.3f", similarity)


def embedding_text(name: Column, body: Column) -> Column:
    """``name. body``; a missing part counts as empty, the separator always stays."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(". "), F.coalesce(body, F.lit("")))


#: Finished chunks are gathered in blocks of this many, as appending to a list copies it.
BLOCK = 128


def _state(blocks: Column, done: Column, current: Column) -> Column:
    return F.struct(blocks.alias("blocks"), done.alias("done"), current.alias("current"))


def _no_chunks() -> Column:
    empty = F.array().cast("array<string>")
    return _state(F.array().cast("array<array<string>>"), empty, F.lit(""))


def _finish(state: Column, more: Column, current: Column) -> Column:
    """Add finished chunks ``more``, full blocks first set aside, and open ``current``."""
    return F.when(
        F.size(state["done"]) >= BLOCK, _state(F.concat(state["blocks"], F.array(state["done"])), more, current)
    ).otherwise(_state(state["blocks"], F.concat(state["done"], more), current))


def _opened(state: Column) -> Column:
    """The open chunk as a list, empty if it holds nothing."""
    return F.when(state["current"] == "", F.array().cast("array<string>")).otherwise(F.array(state["current"]))


def _all_chunks(state: Column) -> Column:
    return F.flatten(F.concat(state["blocks"], F.array(state["done"], _opened(state))))


def _add_piece(state: Column, piece: Column, joiner: str, limit: int) -> Column:
    """Extend the open chunk by ``piece`` if that fits, else close it and open a new one."""
    extended = F.when(state["current"] == "", piece).otherwise(
        F.concat(state["current"], F.lit(joiner), piece)
    )
    return F.when(F.length(extended) <= limit, _state(state["blocks"], state["done"], extended)).otherwise(
        _finish(state, _opened(state), piece)
    )


def pack(pieces: Column, joiner: str, limit: int) -> Column:
    """Greedily join neighbouring pieces into chunks of at most ``limit`` characters.

    A single piece beyond the limit stays whole.
    """
    return F.aggregate(
        pieces, _no_chunks(), lambda state, piece: _add_piece(state, piece, joiner, limit), _all_chunks
    )


#: Marks that combine with the character before them, and the joiner that also binds the one after it.
_BOUND = r"(?![\p{M}\x{200D}])(?<!\x{200D})"


def hard_split(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters that together are the text.

    A character is not parted from the marks that combine with it, unless they alone go beyond the limit.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{limit}}}{_BOUND}|.{{1,{limit}}}"), F.lit(0))


def _within(chunks: Column, limit: int) -> Column:
    """Chunks with those beyond the limit cut up: each of these is one sentence, as :func:`pack` adds nothing to it."""
    return F.flatten(
        F.transform(chunks, lambda chunk: F.when(F.length(chunk) > limit, hard_split(chunk, limit)).otherwise(F.array(chunk)))
    )


def paragraph_chunks(text: Column, limit: int = 900, hard: bool = False, ends: str | None = None) -> Column:
    """Ordered chunks of whole lines; a line beyond ``limit`` is packed by sentence.

    Sentences end at ``". "``, or where the pattern ``ends`` matches (see
    :func:`lexloom.operators.sentences.end_pattern`). The pieces of a long line never share a chunk
    with their neighbours. One unbroken sentence is never cut, so the limit
    binds only where there is a place to split; with ``hard`` it is cut too, and no chunk goes beyond the limit.
    """

    def add_line(state: Column, line: Column) -> Column:
        packed = pack(F.split(line, ends), " ", limit) if ends else pack(F.split(line, r"\. "), ". ", limit)
        return F.when(
            F.length(line) > limit, _finish(state, F.concat(_opened(state), packed), F.lit(""))
        ).otherwise(_add_piece(state, line, "\n", limit))

    chunks = F.aggregate(F.split(text, "\n"), _no_chunks(), add_line, _all_chunks)
    if hard:
        chunks = _within(chunks, limit)
    return F.filter(F.transform(chunks, strip), lambda chunk: chunk != "")


def sentence_chunks(text: Column, limit: int = 480, hard: bool = False, ends: str | None = None) -> Column:
    """Ordered chunks of whole sentences, split at every full stop.

    The closing full stop is added after the length test, so a chunk may reach
    ``limit + 1`` characters. With the pattern ``ends`` sentences end where it matches and keep their own signs. With
    ``hard`` no chunk goes beyond the limit: room is left for the full stop, and a sentence without a place to split is cut.
    """
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    sentences = F.filter(F.transform(F.split(flat, ends or r"\."), strip), lambda sentence: sentence != "")
    if ends:
        chunks = pack(sentences, " ", limit)
        return _within(chunks, limit) if hard else chunks
    if hard:
        return _within(F.transform(pack(sentences, ". ", limit - 1), lambda chunk: F.concat(chunk, F.lit("."))), limit)
    return F.transform(pack(sentences, ". ", limit), lambda chunk: F.concat(chunk, F.lit(".")))


def first_chunks(chunks: Column, n: int) -> Column:
    return F.slice(chunks, 1, n)


def n_dropped(chunks: Column, n: int) -> Column:
    """How many chunks :func:`first_chunks` leaves out."""
    return F.greatest(F.size(chunks) - F.lit(n), F.lit(0))
