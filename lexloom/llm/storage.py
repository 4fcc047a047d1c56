"""Intermediate tables of the operators, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexloom.session import shared_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to a fresh path under ``spark.checkpoint.dir`` and read back.

    What builds on them starts from files, so a lost executor costs only its own tasks.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has, upper and lower case alike."""
    taken = {column.lower() for column in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name
