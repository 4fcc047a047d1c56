"""Registered queries of the subpackage: against their SQL, on held-out labels, and the pipeline stage by stage."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from lexloom.llm import mixing, pieces, quality
from lexloom.llm.oracles import ORACLES
from lexloom.llm.queries import PIECE_MODEL, REGISTERED
from pyspark.sql import functions as F

import corpus_pipeline

from . import brute

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
REPO = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def counted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = REGISTERED[name](spark, FOLDER)
    cursor = database.execute(ORACLES[name])
    columns = [column[0] for column in cursor.description]
    assert counted(result.columns, result.collect()) == counted(columns, cursor.fetchall())


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    scored = REGISTERED[name](spark, LARGER)
    assert scored.count() == 1000
    held = scored.where("held_out").join(labels, "doc_id")
    assert held.where(F.col("predicted") == F.col(label)).count() >= least * held.count()


def test_round_trip(spark):
    rows = REGISTERED["op3_sentencepiece"](spark, FOLDER)
    assert rows.count() == rows.where("round_trip and n_pieces = size(pieces)").count() == 200


def test_all_operators_are_registered():
    assert {int(name[2:].split("_")[0]) for name in REGISTERED} == set(range(1, 14))


def test_pipeline(spark):
    """Every stage against plain Python on what the stage before it kept."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "near duplicates", "source mixing", "sentencepiece",
    ]
    kept, seen = documents, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, FOLDER)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        seen.append([r.asDict() for r in kept.collect()])
        if len(seen) < 5:
            assert kept.columns == documents.columns
    before = {r["doc_id"]: r.asDict() for r in documents.collect()}
    good, deduped, single, mixed, encoded = seen

    model = quality.fit(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = quality.score(documents, model).where("score >= 0.7").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in scored)
    assert all(r == before[r["doc_id"]] for r in good)

    want = brute.line_dedup([(r["doc_id"], r["text"]) for r in good])
    left = {k: t for k, (t, n) in want.items() if n == 0 or brute.WORD.search(t)}
    assert {r["doc_id"]: r["text"] for r in deduped} == left
    assert all(r["n_chars"] == len(r["text"]) for r in deduped)

    groups = brute.near_duplicates(list(left.items()))
    assert sorted(r["doc_id"] for r in single) == sorted(k for k, (_, c) in groups.items() if c == k)

    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(spark.createDataFrame(single, documents.schema)).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({k: n for k, n in copies.items() if n})
    sizes = Counter()
    for r in single:
        sizes[r["source"]] += len(brute.WORD.findall(r["text"]))
    assert all(0 <= n <= 3 for n in copies.values()) and sum(copies.values()) > 0

    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed)
    vocabulary = pieces.automaton_of(PIECE_MODEL).vocabulary
    for r in encoded:
        assert r["round_trip"] and b"".join(vocabulary.surfaces[i] for i in r["pieces"]).decode() == left[r["doc_id"]]


def test_pipeline_runs_in_one_call(spark):
    result = corpus_pipeline.run(spark, FOLDER)
    assert result.count() > 0 and result.where("not round_trip").count() == 0


def test_pipeline_stages_take_odd_tables(spark, odd_documents, no_documents):
    for frame in (odd_documents, no_documents):
        kept = frame
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, FOLDER)
            kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert (kept.count() == 0) or frame is odd_documents


def test_entry_works_without_the_subpackage(tmp_path):
    """The driver's module imports where the subpackage and the pipeline are missing."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((REPO / name).read_text())
    for file in (REPO / "lexloom").rglob("*.py"):
        relative = file.relative_to(REPO)
        if "llm" not in relative.parts:
            (tmp_path / relative).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / relative).write_text(file.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[-1] == "False", said.stderr
