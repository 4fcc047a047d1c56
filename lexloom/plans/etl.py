"""CSV to managed table: scan, clean, write, measure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.clean import clean_incidents, clean_sections, normalise_headers
from lexloom.operators.profile import count_by
from lexloom.sources.csv import read_plain_csv, read_quoted_csv
from lexloom.sources.tables import compute_statistics, write_table


@dataclass(frozen=True)
class LoadedTable:
    """What a load wrote, and the group counts of the written table."""

    table: str
    rows: int
    profile: DataFrame


def _load(df: DataFrame, table: str, fmt: str) -> int:
    written = write_table(df, table, fmt)
    compute_statistics(df.sparkSession, table)
    return written["rows"]


def load_sections(
    spark: SparkSession, csv_path, table: str, fmt: str = "parquet", spread: int | None = None
) -> LoadedTable:
    """Law sections from quoted CSV; the profile counts sections per chapter, by chapter."""
    raw = normalise_headers(read_quoted_csv(spark, csv_path, spread=spread))
    rows = _load(clean_sections(raw), table, fmt)
    return LoadedTable(table, rows, count_by(spark.table(table), "Chapter_name", "sections"))


def load_incidents(spark: SparkSession, csv_path, table: str, fmt: str = "parquet") -> LoadedTable:
    """Labelled incidents from plain CSV; the profile counts incidents per offense, most frequent first."""
    rows = _load(clean_incidents(read_plain_csv(spark, csv_path)), table, fmt)
    return LoadedTable(table, rows, count_by(spark.table(table), "offense_type", "count", by_count=True))
