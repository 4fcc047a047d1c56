"""Managed tables: create, write, measure, compact."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_dir


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{place}")


def write_table(
    df: DataFrame,
    table: str,
    fmt: str = "parquet",
    metrics: dict[str, Column] | None = None,
    rebalance: bool = False,
    partition_by: Sequence[str] = (),
) -> dict:
    """Replace ``table`` by ``df``, schema included, and return the metrics of the written rows.

    Row counts and any further ``metrics`` are gathered while writing, so the
    source is read once. ``rebalance`` evens out file sizes at the price of a
    shuffle; leave it off where the scan already yields well-sized partitions.
    """
    observed = Observation()
    named = [column.alias(name) for name, column in (metrics or {}).items()]
    out = df.hint("rebalance", *partition_by) if rebalance else df
    out = out.observe(observed, F.count(F.lit(1)).alias("rows"), *named)
    writer = out.write.format(fmt).mode("overwrite")
    if fmt == "delta":
        writer = writer.option("overwriteSchema", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    return observed.get


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def compute_statistics(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def column_statistics(spark: SparkSession, table: str) -> DataFrame:
    """``(column, statistic, value)`` as kept in the catalog, one row per figure."""
    columns: Iterable[str] = spark.table(table).columns
    parts = [
        spark.sql(f"DESCRIBE EXTENDED {table} `{name}`").select(
            F.lit(name).alias("column"),
            F.col("info_name").alias("statistic"),
            F.col("info_value").alias("value"),
        )
        for name in columns
    ]
    figures = reduce(DataFrame.unionByName, parts)
    return figures.where(
        F.col("statistic").isin("min", "max", "num_nulls", "distinct_count", "avg_col_len", "max_col_len")
    )


def set_write_properties(spark: SparkSession, table: str, properties: dict[str, str]) -> None:
    """Attach table properties, e.g. the write-size settings a table format understands.

    Plain Parquet ignores them; there :func:`compact_table` does the work.
    """
    pairs = ", ".join(f"'{key}' = '{value}'" for key, value in properties.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [column.name for column in spark.catalog.listColumns(table) if column.isPartition]


def write_properties(spark: SparkSession, table: str) -> dict[str, str]:
    """The properties a user has set on a table."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    return {r["key"]: r["value"] for r in rows if not r["key"].startswith(("transient_", "spark.sql.", "numFiles", "totalSize"))}


def has_statistics(spark: SparkSession, table: str) -> bool:
    """Whether the catalog keeps row counts of a table, as ANALYZE leaves them."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Statistics'").collect()
    return any("rows" in (r["data_type"] or "") for r in rows)


def compact_table(spark: SparkSession, table: str) -> dict:
    """Rewrite ``table`` into evenly sized files.

    The rows are copied to the shared folder first, so the table is never overwritten while
    being read and the copy stays if the second write fails. They are then inserted
    over the old ones: partitioning, properties, comment and location belong to
    the table and stay. Statistics are taken again where there were some. Readers
    should be quiet during the second write.
    """
    by, measured = partition_columns(spark, table), has_statistics(spark, table)
    columns = spark.table(table).columns
    path = shared_dir(spark, "compact")
    seen = Observation()
    spark.table(table).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    copy = spark.read.schema(spark.table(table).schema).parquet(path).select(*columns)
    copy.hint("rebalance", *by).write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)
    if measured:
        compute_statistics(spark, table)
    return seen.get
