"""Chunk folds against a plain statement of the rules, and the small text helpers."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import chunking


def greedy(pieces, joiner, limit):
    chunks, current = [], ""
    for piece in pieces:
        longer = current + joiner + piece if current else piece
        if len(longer) <= limit:
            current = longer
            continue
        chunks += [current] if current else []
        current = piece
    return chunks + ([current] if current else [])


def expected_paragraph_chunks(body, limit):
    groups, run = [], []
    for line in body.split("\n"):
        if len(line) > limit:
            groups += [(run, "\n"), (line.split(". "), ". ")]
            run = []
        else:
            run.append(line)
    groups.append((run, "\n"))
    packed = [chunk.strip() for pieces, joiner in groups for chunk in greedy(pieces, joiner, limit)]
    return [chunk for chunk in packed if chunk]


def expected_sentence_chunks(body, limit):
    sentences = [s.strip() for s in body.replace("\n", " ").split(".")]
    return [chunk + "." for chunk in greedy([s for s in sentences if s], ". ", limit)]


def folded(spark, bodies, expression):
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, t string")
    return [r[1] for r in df.select("i", expression.alias("c")).orderBy("i").collect()]


EDGES = [
    "",
    "\n\n\nfirst",
    "a" * 40,
    "a" * 41,
    "a" * 60 + ". " + "b" * 10,
    "one. two. three. four. five. six. seven. eight. nine\nshort\nshort too",
    "x" * 20 + "\n" + "y" * 19,
    "x" * 20 + "\n" + "y" * 20,
    ".....",
    "3.14 and e.g. this",
    "   padded 　",
    "line\r\nline",
    "  \n \n ",
]


def test_chunk_edges(spark):
    assert folded(spark, EDGES, text.paragraph_chunks(F.col("t"), 40)) == [
        expected_paragraph_chunks(body, 40) for body in EDGES
    ]
    assert folded(spark, EDGES, text.sentence_chunks(F.col("t"), 40)) == [
        expected_sentence_chunks(body, 40) for body in EDGES
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab.. \né\U0001f600"), max_size=200), min_size=1, max_size=30))
def test_chunks_match_the_rules(spark, bodies):
    assert folded(spark, bodies, text.paragraph_chunks(F.col("t"), 25)) == [
        expected_paragraph_chunks(body, 25) for body in bodies
    ]
    assert folded(spark, bodies, text.sentence_chunks(F.col("t"), 25)) == [
        expected_sentence_chunks(body, 25) for body in bodies
    ]


def test_default_limits_and_uncut_sentences(spark):
    unbroken = "w" * 901
    assert folded(spark, [unbroken], text.paragraph_chunks(F.col("t"))) == [[unbroken]]
    exact = "s" * 480
    assert folded(spark, [exact], text.sentence_chunks(F.col("t"))) == [[exact + "."]]
    paragraph = "p" * 900
    assert folded(spark, [paragraph + "\nnext"], text.paragraph_chunks(F.col("t"))) == [[paragraph, "next"]]


def test_first_chunks_report_what_they_leave_out(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "c array<string>")
    out = df.select(text.first_chunks(F.col("c"), 3), text.n_dropped(F.col("c"), 3)).collect()
    assert [tuple(r) for r in out] == [(["a", "b", "c"], 1), (["a"], 0), ([], 0)]


def test_explode_and_rejoin(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, None)], "k int, c array<string>")
    chunks = chunking.explode_chunks(df, F.col("c"), "k")
    assert [tuple(r) for r in chunks.orderBy("chunk_no").collect()] == [(1, 0, "b"), (1, 1, "a")]
    assert [tuple(r) for r in chunking.join_chunks(chunks.repartition(3), "k").collect()] == [(1, "b\na")]


def test_small_helpers(spark):
    df = spark.createDataFrame([("  x\t", None)], "a string, b string")
    row = df.select(
        text.strip(F.col("a")).alias("strip"),
        text.is_blank(F.col("b")).alias("blank"),
        text.preview(F.lit("abc"), 5).alias("short"),
        text.preview(F.lit("\U0001f600bcdef"), 2).alias("cut"),
        text.embedding_text(F.col("b"), F.lit("body")).alias("embedded"),
        text.similarity_label(F.lit(0.12349)).alias("label"),
        text.flatten_line_breaks(F.lit("a\r\nb\rc\n\nd")).alias("flat"),
    ).first()
    assert tuple(row) == ("x", True, "abc…", "\U0001f600b…", ". body", "0.123", "a b c  d")
