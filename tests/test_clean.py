import pytest
from pyspark.sql import functions as F

from lexloom.operators import clean, profile


def test_headers_collapse_runs_and_lose_ends(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF(" Chapter _name ", "_x_", "a \t b")
    assert clean.normalise_headers(df).columns == ["Chapter_name", "x", "a_b"]


def test_colliding_headers_raise(spark):
    df = spark.createDataFrame([(1, 2)], ["p", "q"]).toDF(" a  b ", "a__b")
    with pytest.raises(ValueError, match="a_b"):
        clean.normalise_headers(df)


def sections(spark, rows):
    schema = (
        "Chapter string, Chapter_name string, Chapter_subtype string, Section string, "
        "Section_name string, Description string, extra string"
    )
    return spark.createDataFrame(rows, schema)


def test_sections_are_trimmed_flattened_and_filtered(spark):
    long = "x" * 21
    rows = [
        (" 1 ", "A", None, " 303 ", " Theft ", " one\r\ntwo\rthree\n\nfour of them ", "kept"),
        ("1", "A", None, "304", "short", "x" * 20, "dropped"),
        ("1", "A", None, "305", "just long enough", long, "kept"),
        ("1", "A", None, "306", "no text", None, "dropped"),
        ("1", "A", None, "Section", "header", long, "dropped"),
        ("1", "A", None, " Section ", "header", long, "dropped"),
        ("1", "A", None, None, "no key", long, "dropped"),
        ("1", "A", "\tsub ", "307", "tab", long, "kept"),
    ]
    out = clean.clean_sections(sections(spark, rows)).orderBy("Section").collect()
    assert [r["Section"] for r in out] == ["303", "305", "307"]
    assert {r["extra"] for r in out} == {"kept"}
    assert out[0]["Description"] == "one two three  four of them"
    assert (out[0]["Chapter"], out[0]["Section_name"]) == ("1", "Theft")
    assert out[2]["Chapter_subtype"] == "\tsub"


def test_incidents_need_more_than_five_characters(spark):
    rows = [(" 12345 ", "Theft"), (" 123456", " Theft "), (None, "Theft"), ("चोरी हुई", "Theft")]
    df = spark.createDataFrame(rows, "incident_description string, offense_type string")
    out = clean.clean_incidents(df).collect()
    assert {(r[0], r[1]) for r in out} == {("123456", "Theft"), ("चोरी हुई", "Theft")}


def test_counts_keep_the_null_group_and_break_ties_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "k string")
    assert [tuple(r) for r in profile.count_by(df, "k", "n").collect()] == [
        (None, 1), ("a", 1), ("b", 2), ("c", 1)
    ]
    assert [tuple(r) for r in profile.count_by(df, "k", by_count=True).collect()] == [
        ("b", 2), (None, 1), ("a", 1), ("c", 1)
    ]
    assert profile.row_count(df).first()["rows"] == 5


def test_preview_cuts_values_as_a_console_would(spark):
    df = spark.createDataFrame([(2, "x" * 81), (1, "y" * 80), (3, "z")], "k int, t string")
    out = profile.table_preview(df, "k", n=2).collect()
    assert [tuple(r) for r in out] == [("1", "y" * 80), ("2", "x" * 77 + "...")]
    assert profile.table_preview(df.select(F.col("k")), "k").count() == 3
