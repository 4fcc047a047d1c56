"""Tables in numbered versions: staged writes, commit markers, pinned reads, and compaction of small files.

A table is a folder. Files of rows are written into a segment of their own and never changed. A version is a marker that names the
segments, or the files of a segment, which make up the table; a write counts once its marker is there, in one step. The
current version is the highest marker. What a failed write leaves behind is named by no marker. Readers keep the files of
the version they began with, whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.sources.markers import Markers

#: A list of files up to this size is broadcast to tell rows their new file; a longer one is joined.
BROADCAST_BYTES = 32 << 20


class Conflict(RuntimeError):
    """Another version was committed since the one that a change was based on."""


@dataclass(frozen=True)
class Segment:
    """A folder of files below the table's; ``files`` are the paths that count, relative to it, None for all."""

    name: str
    files: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Version:
    number: int
    schema: dict
    segments: tuple[Segment, ...]
    partition_by: tuple[str, ...] = ()
    properties: dict[str, str] = field(default_factory=dict)
    figures: dict[str, int] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)


class VersionedTable:
    """The versions of one table below ``folder``, which all executors and the driver can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._markers = Markers(spark, f"{self.folder}/_versions")

    # Markers

    def versions(self) -> list[int]:
        return [int(name) for name in self._markers.names()]

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def version(self, number: int | None = None) -> Version:
        number = self.current() if number is None else number
        held = None if number is None else self._markers.get(_name(number))
        if held is None:
            raise FileNotFoundError(f"{self.folder} has no version {number if number is not None else 'yet'}")
        segments = tuple(Segment(s["name"], None if s["files"] is None else tuple(s["files"])) for s in held["segments"])
        return Version(**{**held, "segments": segments, "partition_by": tuple(held["partition_by"])})

    def commit(self, draft: Version, based_on: int | None = None) -> Version:
        """Make ``draft`` the next version. With ``based_on``, only if that is still the current one.

        The number is claimed by creating a file that must not exist, so two writers never share one; the marker then appears by
        renaming, complete. A writer that dies in between leaves its number unused.
        """
        number = max((int(name) for name in self._markers.names(".claim")), default=-1) + 1
        while not self._markers.claim(_name(number)):
            number += 1
        current = self.current()
        if based_on is not None and current != based_on:
            raise Conflict(f"version {current} was committed after {based_on}")
        version = replace(draft, number=number)
        self._markers.put(_name(number), asdict(version))
        return version

    # Rows

    def stage(self, df: DataFrame, partition_by: Sequence[str] = (), metrics: dict[str, Column] | None = None) -> tuple[Segment, dict]:
        """Write rows into a segment that no version names yet; the segment, and ``rows`` and other metrics of what was written."""
        segment, seen = Segment(uuid.uuid4().hex), Observation()
        named = [column.alias(name) for name, column in (metrics or {}).items()]
        out = df.observe(seen, F.count(F.lit(1)).alias("rows"), *named).write
        if partition_by:
            out = out.partitionBy(*partition_by)
        out.parquet(f"{self.folder}/{segment.name}")
        return segment, seen.get

    def write(
        self,
        df: DataFrame,
        partition_by: Sequence[str] = (),
        properties: dict[str, str] | None = None,
        metrics: dict[str, Column] | None = None,
        check: Callable[[dict], None] | None = None,
        based_on: int | None = None,
    ) -> Version:
        """Replace all rows, schema included. ``check`` sees the metrics of the staged rows and may raise: then nothing changes.

        Rows are written once, and the source is read once.
        """
        segment, figures = self.stage(df, partition_by, metrics)
        if check:
            check(figures)
        schema = json.loads(df.schema.json())
        return self.commit(Version(-1, schema, (segment,), tuple(partition_by), properties or {}, figures), based_on)

    def append(self, df: DataFrame) -> Version:
        """Add rows; the table is created by the first. Columns must be those of the table."""
        current = self.current()
        if current is None:
            return self.write(df)
        version = self.version(current)
        segment, figures = self.stage(df.select(*version.struct.fieldNames()), version.partition_by)
        return self.commit(replace(version, segments=(*version.segments, segment), figures=figures), based_on=current)

    def read(self, number: int | None = None, metadata: bool = False) -> DataFrame:
        """The rows of a version, the current one at the time of the call. ``metadata`` adds ``file``, ``file_bytes``, ``segment``."""
        version = self.version(number)
        parts = [self._read_segment(version, segment, metadata) for segment in version.segments]
        if not parts:
            return self.spark.createDataFrame([], version.struct)
        return reduce(DataFrame.unionByName, parts)

    def _read_segment(self, version: Version, segment: Segment, metadata: bool) -> DataFrame:
        base = f"{self.folder}/{segment.name}"
        paths = [base] if segment.files is None else [f"{base}/{file}" for file in segment.files]
        columns = [F.col(f"`{name}`") for name in version.struct.fieldNames()]
        if metadata:
            columns += [
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_size").alias("file_bytes"),
                F.lit(segment.name).alias("segment"),
            ]
        return self.spark.read.schema(version.struct).option("basePath", base).parquet(*paths).select(*columns)

    def files(self, number: int | None = None) -> DataFrame:
        """``(segment, file, file_bytes, rows, partition columns)`` of a version, counted from the files' own metadata."""
        by = self.version(number).partition_by
        rows = self.read(number, metadata=True)
        return rows.groupBy("segment", "file", "file_bytes", *by).agg(F.count(F.lit(1)).alias("rows"))

    # Compaction

    def compact(self, target_bytes: int = 128 << 20, small_below: float = 0.75) -> Version:
        """Merge small files into files of up to ``target_bytes``; other files stay as they are.

        Files below ``small_below`` of the target are packed, within their partition, first-fit by falling size. Only files that share a
        pack with others are read and rewritten, each pack by one task. Rows, schema, partitions and properties stay. If
        another version was committed meanwhile, nothing changes and :class:`Conflict` is raised. The list of files passes the
        driver, as it does whenever the table is read.
        """
        version = self.version()
        by = list(version.partition_by)
        small = self.files(version.number).where(F.col("file_bytes") < small_below * target_bytes)
        listed = small.select("segment", "file", "file_bytes", F.to_json(F.struct(*by)).alias("part") if by else F.lit("").alias("part"))
        listed = listed.orderBy("part", F.col("file_bytes").desc(), "file").collect()
        packs: list[list] = []
        for part in dict.fromkeys(r["part"] for r in listed):
            packs += first_fit([(r, r["file_bytes"]) for r in listed if r["part"] == part], target_bytes)
        packs = [pack for pack in packs if len(pack) > 1]
        if not packs:
            return version
        moved = [(r["file"], i) for i, pack in enumerate(packs) for r in pack]
        where = self.spark.createDataFrame(moved, "file string, pack int")
        if sum(len(file) + 16 for file, _ in moved) <= BROADCAST_BYTES:
            where = F.broadcast(where)
        gone = {(r["segment"], _below(r["file"], r["segment"])) for pack in packs for r in pack}
        old = self._only(version, gone, keep=False)
        rows = self._rows_of(old).join(where, "file").drop("file", "file_bytes", "segment")
        rows = rows.repartitionById(len(packs), F.col("pack")).drop("pack")
        segment, _ = self.stage(rows, by)
        kept = self._only(version, gone, keep=True)
        return self.commit(replace(version, segments=(*kept.segments, segment)), based_on=version.number)

    def _rows_of(self, version: Version) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._read_segment(version, s, True) for s in version.segments])

    def _paths(self, segment: Segment) -> tuple[str, ...]:
        return self._list(segment) if segment.files is None else segment.files

    def _only(self, version: Version, chosen: set[tuple[str, str]], keep: bool) -> Version:
        """The version without the ``chosen`` (segment, file), or with them alone; segments without files go."""
        segments = []
        for segment in version.segments:
            left = tuple(file for file in self._paths(segment) if ((segment.name, file) in chosen) != keep)
            if left:
                segments.append(Segment(segment.name, left))
        return replace(version, segments=tuple(segments))

    def without(self, version: Version, is_gone: Callable[[str], bool]) -> tuple[Segment, ...]:
        """The segments of a version less the files whose path below their segment is ``is_gone``."""
        gone = {(s.name, file) for s in version.segments for file in self._paths(s) if is_gone(file)}
        return self._only(version, gone, keep=True).segments

    def _list(self, segment: Segment) -> tuple[str, ...]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{segment.name}")
        found, walk = [], path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while walk.hasNext():
            file = walk.next().getPath().toUri().getPath()
            if file.endswith(".parquet"):
                found.append(file.rpartition(f"/{segment.name}/")[2])
        return tuple(sorted(found))


def _name(number: int) -> str:
    return f"{number:012d}"


def _below(uri: str, segment: str) -> str:
    """Path of a file below its segment's folder, from the encoded form that the scan reports."""
    return unquote(uri.rpartition(f"/{segment}/")[2])


def first_fit(sized: list[tuple[object, int]], capacity: int) -> list[list]:
    """Pack things into as few packs as first-fit finds, in the order given: each goes into the first pack with room.

    A tree over the packs' room finds that pack in as many steps as the number of packs has digits.
    """
    n = 1
    while n < len(sized):
        n *= 2
    room = [capacity] * (2 * n)
    packs: list[list] = [[] for _ in range(n)]
    for thing, size in sized:
        at = 1
        if room[1] < size:
            packs.append([thing])  # larger than any pack has room for
            continue
        while at < n:
            at = 2 * at if room[2 * at] >= size else 2 * at + 1
        packs[at - n].append(thing)
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return [pack for pack in packs if pack]
