"""Secret scans over a ledger of contents: every content is scanned once for each version of a rule.

A text's address is its SHA-256. The ledger, a folder, holds the addresses that every path has had and, for
each address, the versions of the rules it was scanned with and the spans they found. A scan looks only at
pairs of address and rule version that the ledger lacks, and findings are joined back to paths by address.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_dir

#: A set of unseen addresses up to this size (rows times ``ADDRESS_BYTES``) is broadcast to pick their texts.
BROADCAST_BYTES = 16 << 20
ADDRESS_BYTES = 100


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @cached_property
    def version(self) -> str:
        """Changes with anything that could change a finding, and with nothing else."""
        parts = (self.kind, self.pattern, self.least, self.group, self.any_case)
        return f"{self.kind}-{hashlib.sha256(repr(parts).encode()).hexdigest()[:16]}"

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        for match in re.compile(self.pattern, flags).finditer(text):
            if match.end(self.group) - match.start(self.group) >= self.least:
                yield match.span()


# The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # Every run that is too short is passed over by the count itself, which finds the same runs.
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds beyond the base ones: key blocks, web tokens and tokens with a vendor's prefix.
MORE_RULES = (
    Rule("keyblock", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*"),
    Rule("webtoken", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"),
    Rule("vendor", r"(?:gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
)
RULES = BASE_RULES + MORE_RULES

_SPANS = "array<struct<start:int,place:int,stop:int,version:string>>"


def address(text: Column) -> Column:
    """Binary SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class SecretLedger:
    """Addresses, scans and findings kept in ``folder``.

    Every call of :meth:`add` writes new files and changes none. A run that fails half-way leaves rows that are
    true by themselves, as each tells its address; what it did not reach is unseen to the next run. Two runs at
    the same time may scan an address twice, which changes no result.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, rules: tuple[Rule, ...] = RULES):
        if len({rule.kind for rule in rules}) < len(rules):
            raise ValueError("two rules of one kind")
        self.spark, self.rules = spark, rules
        self.folder = folder or shared_dir(spark, "secret-ledger")

    def _read(self, part: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{part}")

    def scans(self) -> DataFrame:
        """One row per address: ``versions`` it was scanned with, ``spans`` they found, without repeats."""
        kept = self._read("scans", f"blob binary, versions array<string>, spans {_SPANS}")
        if kept is None:
            return self.spark.createDataFrame([], f"blob binary, versions array<string>, spans {_SPANS}")
        merged = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
        return kept.groupBy("blob").agg(merged("versions"), merged("spans"))

    def history(self, key_type: str) -> DataFrame | None:
        """Every path and address that was ever added: ``path``, ``blob``."""
        kept = self._read("paths", f"path {key_type}, blob binary, batch string")
        return None if kept is None else kept.select("path", "blob").distinct()

    def add(self, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Take in a version of the documents, scan what is unseen, and return ``path``, ``blob`` per row.

        Texts that stand in several rows are moved and scanned once. Texts of addresses that were
        scanned with all rules before are not moved when the unseen addresses are few enough to broadcast.
        """
        batch = uuid.uuid4().hex
        rows = documents.select(documents[key].alias("path"), documents[text].alias("text"))
        folder = f"{self.folder}/paths/{batch}"
        rows.select("path", address(F.col("text")).alias("blob"), F.lit(batch).alias("batch")).write.parquet(folder)
        kind = rows.schema["path"].dataType.simpleString()
        paths = self.spark.read.schema(f"path {kind}, blob binary, batch string").parquet(folder).select("path", "blob")

        current = F.array(*(F.lit(rule.version) for rule in self.rules))
        blobs = rows.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        if self._read("scans", "blob binary") is None:
            unseen = self._one_each(blobs).select("blob", "text", current.alias("missing"))
        else:
            seen = self.scans().select("blob", "versions")
            missing = F.array_except(current, F.coalesce("versions", F.array().cast("array<string>")))
            wanted = paths.select("blob").distinct().join(seen, "blob", "left").select("blob", missing.alias("missing"))
            wanted = self._kept(wanted.where(F.size("missing") > 0), "wanted")
            if wanted.count() * ADDRESS_BYTES <= BROADCAST_BYTES:
                unseen = self._one_each(blobs.join(F.broadcast(wanted.select("blob")), "blob", "left_semi"))
            else:
                unseen = self._one_each(blobs)
            unseen = unseen.join(wanted, "blob")
        found = unseen.mapInArrow(_scanner(self.rules), f"blob binary, versions array<string>, spans {_SPANS}")
        found.write.parquet(f"{self.folder}/scans/{batch}")
        return paths

    def _one_each(self, blobs: DataFrame) -> DataFrame:
        """One row per address. Copies in a task leave before the shuffle, so no address gathers more than a row a task."""
        return blobs.groupBy("blob").agg(F.first("text").alias("text"))

    def _kept(self, df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(self.spark, purpose)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def report(self, paths: DataFrame) -> DataFrame:
        """Findings of this ledger's rules joined to ``path``, ``blob``: adds ``spans``, in order of start and rule."""
        order = F.create_map(*(x for i, rule in enumerate(self.rules) for x in (F.lit(rule.version), F.lit(i))))
        current = F.array(*(F.lit(rule.version) for rule in self.rules))
        now = F.filter("spans", lambda s: F.array_contains(current, s["version"]))
        placed = F.transform(
            now,
            lambda s: F.struct(s["start"].alias("start"), order[s["version"]].alias("place"), s["stop"].alias("stop")),
        )
        # Written first: a content that very many paths share is then split by the adaptive skew join.
        found = self._kept(self.scans().select("blob", F.array_sort(placed).alias("spans")), "findings")
        return paths.join(found, "blob", "left")


def _scanner(rules: tuple[Rule, ...]):
    by_version = {rule.version: (place, rule) for place, rule in enumerate(rules)}
    kind = pa.struct([("start", pa.int32()), ("place", pa.int32()), ("stop", pa.int32()), ("version", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            missing = batch.column("missing").to_pylist()
            for text, versions in zip(batch.column("text"), missing, strict=True):
                content, found = text.as_py(), []
                for version in versions:
                    place, rule = by_version[version]
                    found += [
                        {"start": start, "place": place, "stop": stop, "version": version}
                        for start, stop in rule.find(content)
                    ]
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array(missing, pa.list_(pa.string())), pa.array(spans, pa.list_(kind))],
                ["blob", "versions", "spans"],
            )

    return run


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as text: ``kind:start:end``, comma-joined."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"], s["stop"])
    return F.array_join(F.transform(spans, one), ",")


def scan_secrets(
    documents: DataFrame, key: str = "doc_id", text: str = "text", ledger: SecretLedger | None = None
) -> DataFrame:
    """Spans of secrets in each text, found through ``ledger`` (a fresh one unless given).

    Returns the key and ``spans``, an array of structs ``start``, ``place`` (number of the rule) and ``stop`` in code
    points, end exclusive, in order of start and rule; empty where nothing was found.

    A null text counts as empty; empty texts have no spans. Repeated rows stay and get the same spans; rows that share a
    key but not a text are versions of one path and are judged one by one. A null key stays null. Other
    columns are left out, so their names cannot clash. An empty table gives no rows. A text is scanned
    whole in one task, in time proportional to its length.
    """
    ledger = ledger or SecretLedger(documents.sparkSession)
    found = ledger.report(ledger.add(documents, key, text))
    return found.select(F.col("path").alias(key), "spans")
