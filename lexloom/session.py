"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

FULL_SPLIT = 128 << 20


def build_session(app_name: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs here rely on.

    On a cluster ``master`` and the sizing come from spark-submit; only
    settings that change plans are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.driver.host", "127.0.0.1")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.ui.enabled", "false")
            )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="lexloom-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path that every executor can reach.

    The folder is the one named by ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder: on a cluster a machine-local
    path would be lost with its machine, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: computed once however often they are used."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Steps that keep the partitions of the rows they are given.
_IN_PLACE = frozenset({"Project", "Filter", "Generate", "SubqueryAlias"})
_SCANS = frozenset({"LogicalRelation", "LogicalRDD", "LocalRelation", "Range"})


def _is_bare_scan(df: DataFrame) -> bool:
    """Whether the rows come from one scan without a shuffle, so that their partitions are known before anything runs."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in _IN_PLACE:
        node = node.children().head()
    return node.nodeName() in _SCANS


def spread_small_input(df: DataFrame) -> DataFrame:
    """Give text-heavy work one task per core when a scan yields fewer partitions than that.

    A small table often arrives as one file that a single task would read and
    then work through alone. Its rows are dealt out first. A scan of at least one
    partition per core keeps the partitions it has, whatever its size. Rows that come out of a
    shuffle are left alone: how many partitions they have is known only once it has run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _is_bare_scan(df) and df.rdd.getNumPartitions() < cores else df
