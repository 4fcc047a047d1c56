"""CSV scans. Every column is a string; types are the caller's business."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Stands for NULL while reading, so that a quoted empty field is not taken for one; an unquoted empty field is NULL.
NO_TEXT = "\u0000"


def string_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_plain_csv(spark: SparkSession, path, schema: T.StructType | None = None) -> DataFrame:
    """A one-line-per-row UTF-8 file with a header. Large files are split across tasks."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_quoted_csv(
    spark: SparkSession,
    path,
    schema: T.StructType | None = None,
    spread: int | None = None,
) -> DataFrame:
    """A UTF-8 file whose quoted fields may hold line breaks and doubled quotes.

    Such a file cannot be split, so one file is one task: supply many files,
    or pass ``spread`` to redistribute the rows before heavier work. An empty field is
    NULL, a quoted empty field is an empty string. Without a
    schema the header of one file is read to name the columns.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", NO_TEXT)
        .option("emptyValue", "")
        .option("encoding", "UTF-8")
    )
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.repartition(spread) if spread else rows


def write_csv(df: DataFrame, path: str) -> None:
    """Write files that :func:`read_quoted_csv` reads back without loss."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode("overwrite")
        .csv(path)
    )
