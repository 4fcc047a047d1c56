"""Every registered query against its SQL on the smallest tables, and the shape of some plans."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from lexloom.catalog import queries as catalog
from lexloom.operators import chunking, language
from lexloom.functions import text
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
TABLES = ("customer", "part", "events", "documents", "embeddings", "benchmark", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def counted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert catalog.REGISTERED.keys() <= entry.queries().keys()
    assert catalog.REGISTERED.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.REGISTERED))
def test_query_equals_sql(spark, database, name):
    result = entry.queries()[name](spark, FOLDER)
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert counted(result.columns, result.collect()) == counted(columns, cursor.fetchall())


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns == ["query_id", "n_sections", "context"] and result.count() > 0


def test_results_do_not_depend_on_the_number_of_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for partitions in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            results.append(
                [
                    sorted(map(str, catalog.REGISTERED[name](spark, FOLDER).collect()))
                    for name in ("topk_cosine_k5", "sparse_retrieval_k5", "lang_detect", "retrieval_context")
                ]
            )
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_cut_once_and_without_a_shuffle(spark):
    documents = catalog.table(spark, FOLDER, "documents")
    listed = documents.select("doc_id", text.sentence_chunks(F.col("text")).alias("c"))
    plan = plan_of(chunking.explode_chunks(listed, F.col("c"), "doc_id"))
    assert plan.count("split(replace(") == 1 and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_detection_reads_three_columns_and_only_deals_out_small_input(spark):
    profile = catalog._profile(spark, FOLDER)
    turns = catalog.table(spark, FOLDER, "conversations")
    plan = plan_of(language.detect_language(turns, "conv_id", "text", profile, keep=("turn",)))
    assert "hashpartitioning" not in plan and "Join" not in plan
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan


def test_no_query_crosses_two_tables(spark):
    for name in ("topk_cosine_k5", "sparse_retrieval_k5", "retrieval_context", "chat_requests", "hint_block"):
        plan = plan_of(catalog.REGISTERED[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
