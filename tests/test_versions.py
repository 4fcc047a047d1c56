"""Versions, compaction, the index that follows its table, and streams pinned to versions."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexloom.plans.index import BUCKET, update_index
from lexloom.sources.markers import Markers
from lexloom.sources.vectors import read_embedding_table
from lexloom.sources.versions import Conflict, VersionedTable, first_fit
from lexloom.streaming.retrieval import BatchLog, run_pinned, serve_records

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"))


def test_versions_stay_readable(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    first = spark.range(5).withColumn("x", F.lit("é"))
    second = spark.range(3).withColumn("y", F.col("id") * 2)
    assert table.write(first).number == 0 and table.write(second, metrics={"top": F.max("y")}).figures == {"rows": 3, "top": 4}
    assert table.versions() == [0, 1] and table.current() == 1
    assert rows(table.read(0)) == rows(first) and rows(table.read()) == rows(second)
    with pytest.raises(FileNotFoundError):
        table.read(7)


def test_failed_writes_leave_the_version(spark, table):
    table.write(spark.range(5))

    def refuse(figures):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        table.write(spark.range(9), check=refuse)
    broken = spark.range(9).withColumn("x", F.raise_error(F.lit("half-way")))
    with pytest.raises(Exception, match="half-way"):
        table.write(broken)
    assert table.versions() == [0] and table.read().count() == 5
    assert table.write(spark.range(2)).number == 1


def test_readers_keep_the_version_they_began_with(spark, table):
    table.write(spark.range(5))
    reading = table.read()
    table.write(spark.range(100, 103))
    assert rows(reading) == [(i,) for i in range(5)] and table.read().count() == 3


def test_only_one_of_two_changes_to_a_version_is_committed(spark, table):
    based_on = table.write(spark.range(5)).number
    segment, _ = table.stage(spark.range(2))
    table.append(spark.range(5, 6))
    with pytest.raises(Conflict):
        table.write(spark.range(1), based_on=based_on)
    assert rows(table.read()) == [(i,) for i in range(6)]
    # A writer that died after its claim costs a number, nothing else.
    claimed = table.versions()[-1] + 2
    assert Markers(spark, f"{table.folder}/_versions").claim(f"{claimed:012d}")
    assert table.write(spark.range(1)).number == claimed + 1 and segment.name


@pytest.mark.parametrize("by", [(), ("g",)])
def test_compaction_touches_small_files_alone(spark, table, by):
    wide = spark.range(0, 20_000, 1, 2).selectExpr("id", "uuid() AS text", "concat('a b/', id % 2, '%=') AS g")
    table.write(wide.repartition("g") if by else wide, by, {"owner": "x"})
    for i in range(6):
        table.append(spark.range(100_000 + 10 * i, 100_010 + 10 * i).selectExpr("id", "'é' AS text", "concat('a b/', id % 2, '%=') AS g").coalesce(1))
    before, held = table.files().collect(), rows(table.read())
    large = {r["file"] for r in before if r["file_bytes"] > 100_000}
    small = {r["file"] for r in before} - large
    done = table.compact(target_bytes=200_000)
    after = {r["file"]: r for r in table.files().collect()}
    assert large and large < after.keys() and not small & after.keys() and len(after) == len(large) + (2 if by else 1)
    assert rows(table.read()) == held and rows(table.read(done.number - 1)) == held
    assert done.partition_by == by and done.properties == {"owner": "x"} and done.struct == wide.schema
    assert table.compact(target_bytes=200_000).number == done.number


def test_packs_are_joined_when_their_list_is_long(spark, table, monkeypatch):
    monkeypatch.setattr("lexloom.sources.versions.BROADCAST_BYTES", 0)
    table.write(spark.range(0, 1000, 1, 8))
    table.compact()
    assert table.files().count() == 1 and table.read().agg(F.sum("id")).first()[0] == 499500


def test_first_fit():
    def slow(sizes, capacity):
        packs = []
        for size in sizes:
            pack = next((p for p in packs if sum(p) + size <= capacity), None)
            packs.append([size]) if pack is None else pack.append(size)
        return packs

    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 100):
        sizes = [int(x) for x in r.integers(1, 60, n)]
        assert sorted(first_fit([(s, s) for s in sizes], 60)) == sorted(slow(sizes, 60))
    assert sorted(first_fit([("large", 99), ("a", 1), ("b", 1)], 60)) == [["a", "b"], ["large"]]


MODEL_LOG = {}


def counting_model(folder):
    """A model that leaves a note of every text it sees."""

    def load():
        import uuid

        def encode(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts))
            return np.array([[len(t), t.count("a"), 1.0] if "void" not in t else [0, 0, 0] for t in texts])

        return encode

    return load


def seen_by_model(folder):
    return sorted(line for file in folder.iterdir() for line in file.read_text().splitlines())


def test_index_update_embeds_only_what_changed(spark, tmp_path):
    kind = "Section string, Section_name string, Description string, note string"
    first = [(str(i), f"name {i}", f"text {'a' * i}", "n") for i in range(40)] + [("40", "void", "", "n")]
    notes = tmp_path / "first"
    notes.mkdir()
    path = str(tmp_path / "index")
    made = update_index(spark.createDataFrame(first, kind), path, counting_model(notes), "Section", buckets=8)
    assert made["new"] == made["embedded"] == 41 and len(seen_by_model(notes)) == 41

    second = [r for r in first if r[0] not in {"3", "4"}]
    second = [(s, "changed" if s == "7" else n, d, "other" if s in {"9", "40"} else o) for s, n, d, o in second]
    second += [("50", "fresh", "aa", None), (None, "no key", "x", "n")]
    notes = tmp_path / "second"
    notes.mkdir()
    changed = spark.createDataFrame(second, kind)
    made = update_index(changed, path, counting_model(notes), "Section", buckets=8)
    assert (made["new"], made["changed"], made["edited"], made["gone"], made["same"], made["embedded"]) == (1, 1, 2, 2, 36, 2)
    assert seen_by_model(notes) == [f"changed. text {'a' * 7}", "fresh. aa"] and made["buckets"] < 8

    fresh = str(tmp_path / "anew")
    update_index(changed, fresh, counting_model(notes), "Section", buckets=8)
    columns = ["Section", "Section_name", "Description", "note", "embedding"]
    updated, anew = (read_embedding_table(spark, p).select(*columns) for p in (path, fresh))
    assert rows(updated) == rows(anew) and updated.count() == 39

    # Buckets without a difference keep their very files; a call without changes commits nothing.
    index = VersionedTable(spark, path)
    kept = {r["file"] for r in index.files(0).collect()} & {r["file"] for r in index.files(1).collect()}
    assert len(kept) == index.read(0).select(BUCKET).distinct().count() - made["buckets"] + (0 if made["buckets"] < 8 else 8)
    assert update_index(changed, path, counting_model(notes), "Section", buckets=8)["buckets"] == 0 and index.current() == 1
    with pytest.raises(ValueError, match="buckets"):
        update_index(changed, path, counting_model(notes), "Section", buckets=9)
    with pytest.raises(ValueError, match="columns"):
        update_index(changed.withColumn("extra", F.lit(1)), path, counting_model(notes), "Section", buckets=8)


def test_a_refresh_shows_from_the_next_batch_on(spark, tmp_path):
    corpus, records = (VersionedTable(spark, str(tmp_path / name)) for name in ("corpus", "records"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "key long, embedding array<float>")
    corpus.write(vectors.where("key = 1"))
    records.write(spark.createDataFrame([(1, "old one")], "key long, name string"))
    arriving, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    asked = spark.createDataFrame([(10, [0.0, 1.0])], "query_id long, embedding array<float>")
    asked.write.parquet(arriving)

    def start():
        stream = spark.readStream.schema(asked.schema).parquet(arriving)
        return serve_records(stream, corpus, records, out, state, k=1, every="1 second")

    running = start()
    running.processAllAvailable()
    log = BatchLog(spark, out)
    first = rows(log.results().select("query_id", "key", "name", "corpus_version", "records_version"))
    assert first == [(10, 1, "old one", 0, 0)]
    corpus.write(vectors)
    records.write(spark.createDataFrame([(1, "one"), (2, "two")], "key long, name string"))
    asked.withColumn("query_id", F.lit(11).cast("long")).write.mode("append").parquet(arriving)
    running.processAllAvailable()
    running.stop()
    both = rows(log.results().select("query_id", "key", "name", "corpus_version", "records_version"))
    assert both == [*first, (11, 2, "two", 1, 1)] and log.finished() == [0, 1]
    # Started again there is nothing to do, and nothing changes.
    running = start()
    running.processAllAvailable()
    running.stop()
    assert rows(log.results().select("query_id", "key", "name", "corpus_version", "records_version")) == both


def test_a_batch_that_failed_is_run_again_with_its_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(1))
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(arriving)
    tries = []

    def job(batch, read):
        tries.append(1)
        if len(tries) == 1:
            table.write(spark.range(7))  # a refresh comes while the batch fails
            raise RuntimeError("lost")
        return batch.crossJoin(read["t"].agg(F.count("*").alias("n")))

    def run(state):
        stream = spark.readStream.schema("id long").parquet(arriving)
        running = run_pinned(stream, job, {"t": table}, out, str(tmp_path / state), every=None)
        running.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run("state")
    assert BatchLog(spark, out).results() is None
    run("state")
    found = rows(BatchLog(spark, out).results().select("id", "n", "t_version"))
    assert found == [(i, 1, 0) for i in range(5)]
    run("another state")  # a replay of a finished batch leaves it as it is
    assert len(tries) == 2 and rows(BatchLog(spark, out).results().select("id", "n", "t_version")) == found
