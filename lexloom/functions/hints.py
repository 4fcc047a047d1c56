"""The offense reference that every guidance request carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Offense -> statute reference, in the order they are listed.
OFFENSES = {
    "Theft": "Chapter 17 — BNS Sections 303-305",
    "Robbery": "Chapter 17 — BNS Sections 309-311",
    "Assault": "Chapter 6  — BNS Sections 114-118",
    "Murder": "Chapter 6  — BNS Sections 100-105",
    "Sexual Assault": "Chapter 5  — BNS Sections 63-77",
    "Fraud": "Chapter 17 — BNS Sections 316-318",
    "Cybercrime": "BNS Section 316 + Information Technology Act",
    "Kidnapping": "Chapter 6  — BNS Sections 137-144",
    "Domestic Violence": "Chapter 5  — BNS Sections 85-86",
    "Defamation": "Chapter 19 — BNS Section 356",
    "Extortion": "Chapter 17 — BNS Section 308",
    "Trespass": "Chapter 17 — BNS Sections 329-332",
    "Rioting": "Chapter 11 — BNS Sections 189-195",
    "Corruption": "Chapter 12 — BNS Sections 61, 175-176",
    "Stalking": "Chapter 5  — BNS Section 78",
    "Dowry Death": "Chapter 5  — BNS Section 80",
}


def hint_dimension(spark: SparkSession) -> DataFrame:
    """The fixed table ``(ord, offense, reference)``."""
    rows = [(place, *pair) for place, pair in enumerate(OFFENSES.items())]
    return spark.createDataFrame(rows, "ord int, offense string, reference string")


def hint_block(hints: DataFrame) -> DataFrame:
    """One row ``(hint_block)``: a line per offense in declared order."""
    line = F.concat(F.lit("- "), F.col("offense"), F.lit(": "), F.col("reference"))
    ordered = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    return hints.agg(F.array_join(F.transform(ordered, lambda part: part["line"]), "\n").alias("hint_block"))


def hint_block_column(spark: SparkSession) -> Column:
    """The block as a scalar subquery, computed once and put on every row of a request table."""
    return hint_block(hint_dimension(spark)).scalar()
