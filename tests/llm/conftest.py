import pytest

LONG = "\n".join(f"line {i} holds a few words of its own" for i in range(9000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names operators use themselves."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.\nIt runs on and on.\nThen it rests.", "a"),
        (2, None, None),
        (3, "", "a"),
        (4, " \n\t \n", "b"),
        (5, LONG, "b"),
        (6, "The quick brown fox jumps over the lazy dog.\nIt runs on and on.\nThen it rests.", "c"),
        (6, "The quick brown fox jumps over the lazy dog.\nIt runs on and on.\nThen it rests.", "c"),
        (None, "A text without a key\nthat has two lines", "c"),
        (7, "word", None),
        (8, "é ü 日本語 🙂 ▁   x", "d"),
    ]
    extra = "id long, key string, hash long, score double, predicted int, held_out boolean, pieces string, label int, k int, h int, n long, part int, value long, component long, lines_removed string, size int, n_chars long"
    columns = ["doc_id", "text", "source"]
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string")
    for field in extra.split(", "):
        name, kind = field.split(" ")
        frame = frame.selectExpr("*", f"cast(7 as {kind}) as {name}")
    assert frame.columns[:3] == columns
    return frame


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, 1), (1, 0, 1), (99, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
