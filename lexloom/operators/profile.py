"""Row counts, group counts and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import show_cell


def row_count(df: DataFrame, name: str = "rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(df: DataFrame, key: str, name: str = "count", by_count: bool = False) -> DataFrame:
    """Rows per key, NULL being a group of its own.

    Sorted by key, NULL first, or with ``by_count`` by falling count and then key.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    by_key = F.col(key).asc_nulls_first()
    return counts.orderBy(F.col(name).desc(), by_key) if by_count else counts.orderBy(by_key)


def table_preview(df: DataFrame, order_by: str, n: int = 10, width: int = 80) -> DataFrame:
    """The first ``n`` rows by key with every value cut as a console display would."""
    head = df.orderBy(F.col(order_by).asc_nulls_first()).limit(n)
    return head.select(*[show_cell(F.col(c).cast("string"), width).alias(c) for c in df.columns])
