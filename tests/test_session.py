from types import SimpleNamespace

import pytest

from lexloom import session


def fake(master, setting=None):
    conf = SimpleNamespace(get=lambda name, default: {"spark.checkpoint.dir": setting}[name])
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_comes_from_the_session():
    path = session.shared_dir(fake("yarn", "hdfs://name/scratch/"), "vocabulary")
    assert path.startswith("hdfs://name/scratch/vocabulary-")
    assert path != session.shared_dir(fake("yarn", "hdfs://name/scratch/"), "vocabulary")


def test_only_a_local_master_may_use_a_temporary_folder():
    assert "lexloom-" in session.shared_dir(fake("local[2]"), "csv")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077"), "csv")


def test_only_inputs_of_fewer_partitions_than_cores_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "repeat(uuid(), 3) AS text").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("RoundRobinPartitioning(4)")

    assert exchanges(session.spread_small_input(rows)) == 1
    assert exchanges(session.spread_small_input(spark.range(0, 1000, 1, 40))) == 0


def test_nothing_runs_while_rows_are_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 7 AS g").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    grouped = rows.groupBy("g").count()
    scanned = rows.where("id > 5").selectExpr("id", "explode(array(1, 2)) AS x")
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        assert session.spread_small_input(grouped) is grouped
        assert session.spread_small_input(scanned) is not scanned
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
