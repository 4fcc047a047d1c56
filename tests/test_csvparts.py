"""Quoted CSV read in ranges: equal to the reader that takes a file whole, wherever the borders fall."""

import random

import pytest

from lexloom.sources import csv, csvparts

SCHEMA = csv.string_schema("a", "b", "c")
FIELDS = ["", '""', "x", '"a, b"', '"two\nlines"', '"a ""word"" x"', '"""\n"""', '"\r\nend"', "é😀", '"\n\n\n"', " y ", 'inch 5" pipe', '"' + "z" * 60 + '\n"']


def written_file(path, seed, ending="\n", n=25):
    r = random.Random(seed)
    records = [",".join(r.choice(FIELDS) for _ in range(3)) for _ in range(n)]
    path.write_text(ending.join(["a,b,c", *records]) + (ending if seed % 2 else ""), encoding="utf-8", newline="")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "split"), [(0, 23), (1, 50), (2, 64), (3, 1000)])
def test_any_border_gives_the_rows_of_the_whole_file(spark, tmp_path, seed, split):
    for i in range(2):
        written_file(tmp_path / f"f{i}.csv", seed * 2 + i, "\r\n" if seed == 2 else "\n")
    found = rows(csvparts.read_quoted_csv_in_parts(spark, str(tmp_path), SCHEMA, split_bytes=split))
    if seed == 2:  # the other reader turns the line breaks of such files into plain ones, inside quotes too
        found = sorted((tuple(x and x.replace("\r\n", "\n") for x in row) for row in found), key=repr)
    assert found == rows(csv.read_quoted_csv(spark, str(tmp_path), SCHEMA))


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    written_file(tmp_path / "f.csv", 1, n=300)
    records = csvparts.split_records(spark, str(tmp_path / "f.csv"))
    assert records.where("head").count() == 1
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "256")
    small.conf.set("spark.sql.files.openCostInBytes", "0")
    lines = small.read.option("lineSep", "\n").text(str(tmp_path / "f.csv"))
    assert lines.rdd.getNumPartitions() > 20


def test_one_record_over_many_ranges(spark, tmp_path):
    body = "\n".join(f'line ""{i}"", more' for i in range(500))
    (tmp_path / "f.csv").write_text(f'a,b,c\n1,"{body}",2\n3,,4\n', encoding="utf-8", newline="")
    found = csvparts.read_quoted_csv_in_parts(spark, str(tmp_path / "f.csv"), split_bytes=400)
    assert found.columns == ["a", "b", "c"]
    assert rows(found) == [("1", body.replace('""', '"'), "2"), ("3", None, "4")]


def test_heads_and_empty_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text('"a\nname",b\n1,2\n', encoding="utf-8", newline="")
    (tmp_path / "two.csv").write_text('"a\nname",b\n', encoding="utf-8", newline="")
    (tmp_path / "three.csv").write_text("", encoding="utf-8")
    schema = csv.string_schema("a", "b")
    assert rows(csvparts.read_quoted_csv_in_parts(spark, str(tmp_path), schema, split_bytes=5)) == [("1", "2")]


def test_what_is_written_is_read(spark, tmp_path):
    values = [(' "quoted" ', "a\nb\\"), ("comma, ", None), ("é😀", "tab\t"), ("", "empty"), (None, "")]
    df = spark.createDataFrame(values, "a string, b string")
    csv.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert set(rows(csvparts.read_quoted_csv_in_parts(spark, str(tmp_path / "out"), split_bytes=9))) == set(values)


def test_line_states():
    inside = csvparts.ends_inside
    assert not inside('a,"b",c', False) and inside('a,"b', False) and inside('a,"b""', False)
    assert not inside('b""",c', True) and inside('x,"y",z', True) is False and not inside('5" x', False)
    assert inside("", True) and not inside("", False) and inside('";";"', False, ";") and not inside('";";x', False, ";")
