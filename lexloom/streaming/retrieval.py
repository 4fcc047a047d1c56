"""A stream of requests searched against a static embedding table.

Ranking needs a full sort per query, which a stream cannot express, so each
micro-batch runs the batch operators. A batch is written to a folder of its own
by overwrite: a batch that is replayed after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.retrieval import attach_records, topk
from lexloom.plans.guidance import guidance
from lexloom.sources.markers import Markers
from lexloom.sources.versions import VersionedTable

BatchJob = Callable[[DataFrame], DataFrame]
PinnedJob = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]


def run_batches(requests: DataFrame, job: BatchJob, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that applies ``job`` to all available micro-batches and then stops."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            job(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_topk(
    requests: DataFrame,
    load_corpus: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    k: int = 5,
    **options,
) -> StreamingQuery:
    """Match rows per request. The corpus is read again for each batch, so a refresh is picked up."""
    return run_batches(
        requests, lambda batch: topk(batch, load_corpus(), k, **options).rows, out, checkpoint
    )


def stream_guidance(
    requests: DataFrame,
    load_corpus: Callable[[], DataFrame],
    prepare: BatchJob,
    out: str,
    checkpoint: str,
    load_records: Callable[[], DataFrame] | None = None,
    **options,
) -> StreamingQuery:
    """Chat requests per incoming request; ``prepare`` resolves a batch and adds its query vectors.

    Corpus and records, where they are tables of their own, are read again for each batch.
    """

    def job(batch: DataFrame) -> DataFrame:
        records = {"records": load_records()} if load_records else {}
        return guidance(prepare(batch), load_corpus(), **records, **options)

    return run_batches(requests, job, out, checkpoint)


class BatchLog:
    """What each batch of a stream read and wrote: the versions it is pinned to, and whether its rows count."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self._pins, self._done = Markers(spark, f"{self.out}/_pins"), Markers(spark, f"{self.out}/_done")

    def pin(self, batch_id: int, tables: dict[str, VersionedTable]) -> dict[str, int]:
        """The version of each table for this batch: those of its first attempt, else the current ones."""
        held = self._pins.get(str(batch_id))
        if held is None:
            held = {name: table.version().number for name, table in tables.items()}
            self._pins.put(str(batch_id), held)
        return held

    def is_done(self, batch_id: int) -> bool:
        return self._done.get(str(batch_id)) is not None

    def finish(self, batch_id: int, pins: dict[str, int]) -> None:
        self._done.put(str(batch_id), {"versions": pins})

    def finished(self) -> list[int]:
        return sorted(int(name) for name in self._done.names())

    def results(self) -> DataFrame | None:
        """The rows of all finished batches with their ``batch_id``; those of a batch under way are not seen."""
        paths = [f"{self.out}/batch_id={number}" for number in self.finished()]
        return self.spark.read.option("basePath", self.out).parquet(*paths) if paths else None


def run_pinned(
    requests: DataFrame,
    job: PinnedJob,
    tables: dict[str, VersionedTable],
    out: str,
    checkpoint: str,
    every: str | None = "10 seconds",
) -> StreamingQuery:
    """Start a query that goes on until it is stopped and applies ``job`` to a batch every so often.

    Each batch reads one version of every table, the current one when it first began, and says so in its rows
    (columns ``<name>_version``). A version committed meanwhile is seen from the next batch on. A batch that failed half-way is run again
    with the versions it had; one that was finished is not run again. Without ``every`` the query takes what is there and stops.
    """
    spark = requests.sparkSession
    log = BatchLog(spark, out)

    def write(batch: DataFrame, batch_id: int) -> None:
        if log.is_done(batch_id):
            return
        pins = log.pin(batch_id, tables)
        read = {name: table.read(pins[name]) for name, table in tables.items()}
        batch.persist()
        try:
            rows = job(batch, read).withColumns({f"{name}_version": F.lit(number) for name, number in pins.items()})
            rows.write.mode("overwrite").parquet(f"{log.out}/batch_id={batch_id}")
        finally:
            batch.unpersist()
        log.finish(batch_id, pins)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def serve_records(
    requests: DataFrame,
    corpus: VersionedTable,
    records: VersionedTable,
    out: str,
    checkpoint: str,
    key: str = "key",
    k: int = 5,
    every: str | None = "10 seconds",
    **options,
) -> StreamingQuery:
    """A lasting stream of requests to matched records, corpus and records each at one version a batch."""

    def job(batch: DataFrame, read: dict[str, DataFrame]) -> DataFrame:
        return attach_records(topk(batch, read["corpus"], k, key=key, **options), read["records"], key)

    return run_pinned(requests, job, {"corpus": corpus, "records": records}, out, checkpoint, every)
