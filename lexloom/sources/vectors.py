"""The embedding table: key, payload and unit vector in one versioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import vectors
from lexloom.sources.versions import VersionedTable


def vector_metrics(vector: str) -> dict[str, Column]:
    """What is counted of the rows while they are written."""
    return {
        "stored": F.count_if(F.col(vector).isNotNull()),
        "rejected": F.count_if(F.col(vector).isNull()),
        "shortest": F.min(F.size(vector)),
        "dimension": F.max(F.size(vector)),
    }


def check_dimensions(figures: dict) -> None:
    if figures["stored"] and figures["shortest"] != figures["dimension"]:
        raise ValueError(f"vectors of {figures['shortest']} to {figures['dimension']} elements in one table")


def write_embedding_table(df: DataFrame, path: str, vector: str = "embedding") -> dict:
    """Store unit ``array<float>`` vectors beside their rows, as the next version of the table at ``path``.

    Zero, missing and non-finite vectors cannot be searched: their rows are kept without a vector and not read. The count
    of both kinds of rows is returned with the vector length. Rows are written once and checked before they count: vectors of
    different lengths raise and leave the table as it was.
    """
    unit = df.withColumn(vector, vectors.l2_normalise(F.col(vector)))
    written = VersionedTable(df.sparkSession, path).write(unit, metrics=vector_metrics(vector), check=check_dimensions)
    return {name: written.figures[name] for name in ("stored", "rejected", "dimension")}


def read_embedding_table(spark: SparkSession, path: str, vector: str = "embedding", version: int | None = None) -> DataFrame:
    """The rows that have a vector, of the current version or a given one."""
    return VersionedTable(spark, path).read(version).where(F.col(vector).isNotNull())
