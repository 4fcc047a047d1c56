import pytest
from pyspark.sql import functions as F

from lexloom.plans.etl import load_incidents, load_sections
from lexloom.sources import csv, tables
from lexloom.sources.vectors import read_embedding_table, write_embedding_table

SECTIONS_CSV = (
    'Chapter, Chapter  _name ,Chapter_subtype,Section,Section_name,Description\n'
    '17,Property,,303,"Theft ""simple""","Whoever takes movable property\nfrom another, is said to commit theft."\n'
    '17,Property,,304,Snatching,"Theft is snatching if done suddenly, quickly or forcibly."\n'
    '5,Family,,80,Dowry death,"Death of a woman within seven years\r\nof marriage under cruelty."\n'
    '5,Family,,81,Short,too short\n'
    'Chapter,Chapter_name,Chapter_subtype,Section,Section_name,A header that was repeated in the data\n'
    '5,चोरी,,82,Hindi,"यह एक काफी लंबा विवरण है जो रखा जाएगा"\n'
)


@pytest.fixture
def schema(spark, tmp_path):
    name = f"t_{tmp_path.name}".replace("-", "_")
    tables.ensure_schema(spark, name, str(tmp_path / "schema"))
    tables.ensure_schema(spark, name)
    return name


def test_quoted_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(SECTIONS_CSV, encoding="utf-8", newline="")
    rows = csv.read_quoted_csv(spark, str(path), spread=2)
    assert rows.columns[1] == " Chapter  _name " and set(dict(rows.dtypes).values()) == {"string"}
    by_section = {r["Section"]: r for r in rows.collect()}
    assert by_section["303"]["Section_name"] == 'Theft "simple"'
    assert "\nfrom another, is" in by_section["303"]["Description"]
    assert by_section["304"]["Chapter_subtype"] is None


def test_plain_csv_with_crlf(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_bytes(b"incident_description,offense_type\r\n\"Bike, stolen\",Theft\r\nab,Theft\r\n")
    rows = csv.read_plain_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("Bike, stolen", "Theft"), ("ab", "Theft")]
    declared = csv.read_plain_csv(spark, str(path), csv.string_schema("a", "b"))
    assert declared.columns == ["a", "b"] and declared.count() == 2


def test_csv_round_trip_is_lossless(spark, tmp_path):
    rows = [(' "quoted" ', "a\nb\\"), ("comma, ", None), ("é😀", "tab\t"), ("", "empty"), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    csv.write_csv(df, str(tmp_path / "out"))
    back = csv.read_quoted_csv(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_section_load(spark, tmp_path, schema):
    path = tmp_path / "s.csv"
    path.write_text(SECTIONS_CSV, encoding="utf-8", newline="")
    loaded = load_sections(spark, str(path), f"{schema}.sections")
    assert loaded.rows == 4
    assert [tuple(r) for r in loaded.profile.collect()] == [("Family", 1), ("Property", 2), ("चोरी", 1)]
    stored = spark.table(f"{schema}.sections")
    assert not stored.where(F.col("Description").rlike(r"[\r\n]")).count()
    figures = {(r[0], r[1]): r[2] for r in tables.column_statistics(spark, f"{schema}.sections").collect()}
    assert figures[("Chapter_subtype", "num_nulls")] == "4"


def test_incident_load(spark, tmp_path, schema):
    path = tmp_path / "i.csv"
    path.write_bytes(
        b"incident_description,offense_type\r\nMy bike was stolen,Theft\r\nhit me,Assault\r\n"
        b"hit me again,Assault\r\nshort,Theft\r\n"
    )
    loaded = load_incidents(spark, str(path), f"{schema}.incidents")
    assert loaded.rows == 3
    assert [tuple(r) for r in loaded.profile.collect()] == [("Assault", 2), ("Theft", 1)]


def test_overwrite_may_change_the_schema_and_reports_metrics(spark, schema):
    table = f"{schema}.t"
    tables.write_table(spark.range(5), table)
    wider = spark.range(3).withColumn("x", F.col("id") * 2)
    written = tables.write_table(wider, table, metrics={"top": F.max("x")}, rebalance=True)
    assert written == {"rows": 3, "top": 4}
    assert tables.read_table(spark, table).columns == ["id", "x"]


def test_compaction_keeps_rows_and_reduces_files(spark, schema):
    table = f"{schema}.many"
    tables.write_table(spark.range(0, 1000, 1, 8), table)
    before = len(spark.table(table).inputFiles())
    tables.set_write_properties(spark, table, {"write.optimize": "true"})
    assert tables.compact_table(spark, table)["rows"] == 1000
    assert len(spark.table(table).inputFiles()) < before
    assert spark.table(table).agg(F.sum("id")).first()[0] == 499500


def test_embedding_table_is_normalised_and_counts_rejects(spark, tmp_path):
    rows = [("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [0.0, 2.0])]
    df = spark.createDataFrame(rows, "key string, embedding array<double>")
    counts = write_embedding_table(df, str(tmp_path / "v"))
    assert counts == {"stored": 2, "rejected": 2, "dimension": 2}
    stored = read_embedding_table(spark, str(tmp_path / "v"))
    assert dict(stored.dtypes)["embedding"] == "array<float>"
    assert {r["key"]: r["embedding"] for r in stored.collect()}["d"] == [0.0, 1.0]
    mixed = df.unionByName(spark.createDataFrame([("e", [1.0])], df.schema))
    with pytest.raises(ValueError, match="1 to 2 elements"):
        write_embedding_table(mixed, str(tmp_path / "v"))
    assert read_embedding_table(spark, str(tmp_path / "v")).count() == 2


def test_vectors_that_are_not_finite_are_rejected(spark, tmp_path):
    rows = [("a", [1.0, float("nan")]), ("b", [float("inf"), 1.0]), ("c", [2.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, embedding array<double>")
    assert write_embedding_table(df, str(tmp_path / "v")) == {"stored": 1, "rejected": 2, "dimension": 2}


def test_compaction_keeps_partitions_properties_and_statistics(spark, schema):
    table = f"{schema}.parted"
    rows = spark.range(0, 1000, 1, 8).selectExpr("id", "id % 3 AS g")
    tables.write_table(rows, table, partition_by=["g"])
    tables.set_write_properties(spark, table, {"owner.team": "x"})
    tables.compute_statistics(spark, table)
    tables.compact_table(spark, table)
    assert tables.partition_columns(spark, table) == ["g"]
    assert tables.write_properties(spark, table)["owner.team"] == "x"
    assert tables.has_statistics(spark, table) and spark.table(table).count() == 1000
