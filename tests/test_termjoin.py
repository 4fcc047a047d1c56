"""Sparse retrieval by joins on terms: the block search's result, without pairs that cannot be among the best."""

import random

import pytest

from lexloom.operators import sparse, termjoin
from lexloom.operators.termjoin import JoinSettings


def texts(spark, n, seed, words=60, start=0):
    r = random.Random(seed)
    line = lambda: " ".join("w" + "abcdefgh"[w % 8] * (w // 8 + 1) for w in (min(int(r.expovariate(0.06)), words) for _ in range(r.randint(0, 25))))
    return spark.createDataFrame([(start + i, line()) for i in range(n)] + [(start + n, None), (None, "wa wb")], "key long, text string")


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"settings": JoinSettings(seeds=1, rows_per_salt=7)},
        {"settings": JoinSettings(seeds=2, rows_per_salt=5, salted_terms=2, term_bytes=0)},
        {"vocabulary_bytes": 0},
        {"k": 40},
    ],
)
def test_equals_the_block_search(spark, options):
    documents, asked = texts(spark, 250, 1), texts(spark, 40, 2, start=1000).withColumnRenamed("key", "query_id")
    k = options.pop("k", 5)
    found = termjoin.topk_by_term_join(asked, documents, k, **options)
    blocks = sparse.topk_by_terms(asked, documents, k)
    assert sorted(map(tuple, found.rows.collect())) == sorted(map(tuple, blocks.rows.collect()))
    assert found.rows.count() <= found.at_most


def test_copies_tie_by_key(spark):
    documents = spark.createDataFrame([(i, "alpha beta") for i in range(30)] + [(99, "gamma")], "key long, text string")
    asked = spark.createDataFrame([("q", "alpha gamma"), ("none", "delta"), ("empty", "")], "query_id string, text string")
    found = termjoin.topk_by_term_join(asked, documents, 4)
    blocks = sparse.topk_by_terms(asked, documents, 4)
    assert sorted(map(tuple, found.rows.collect())) == sorted(map(tuple, blocks.rows.collect()))


def test_empty_sides(spark):
    documents, asked = texts(spark, 20, 1), texts(spark, 5, 2).withColumnRenamed("key", "query_id")
    assert termjoin.topk_by_term_join(asked.where("false"), documents).rows.count() == 0
    assert termjoin.topk_by_term_join(asked, documents.where("false")).rows.count() == 0


def test_no_product_of_the_sides(spark):
    documents, asked = texts(spark, 100, 1), texts(spark, 20, 2).withColumnRenamed("key", "query_id")
    plan = termjoin.topk_by_term_join(asked, documents).rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "MapInArrow" not in plan


def test_long_frequent_terms_take_part(spark):
    long_ = "x" * 700
    documents = spark.createDataFrame([(i, f"{long_} {'abc'[i % 3] * 3}") for i in range(50)] + [(99, "zz")], "key long, text string")
    asked = spark.createDataFrame([(1, long_), (2, "aaa")], "query_id long, text string")
    blocks = sorted(map(tuple, sparse.topk_by_terms(asked, documents, 3).rows.collect()))
    for bytes_ in (0, 1 << 20):
        found = termjoin.topk_by_term_join(asked, documents, 3, vocabulary_bytes=bytes_, settings=JoinSettings(rows_per_salt=10))
        assert sorted(map(tuple, found.rows.collect())) == blocks and len(blocks) == 6


def test_a_pair_is_scored_by_joined_terms(spark):
    """Looking each term of a query up in a document's whole map takes the product of the two sides' terms for every pair."""
    documents, asked = texts(spark, 100, 1), texts(spark, 20, 2).withColumnRenamed("key", "query_id")
    plan = termjoin.topk_by_term_join(asked, documents).rows._jdf.queryExecution().executedPlan().toString()
    assert "element_at" not in plan and "lambdafunction" not in plan


def test_rows_of_a_repeated_key_are_scored_one_by_one(spark):
    pairs = spark.createDataFrame([("q", 1)], "query_id string, key long")
    vectors = "terms array<string>, weights array<double>"
    held = spark.createDataFrame([(1, 0, ["a", "b"], [0.6, 0.8]), (1, 1, ["b", "c"], [0.5, 0.5])], f"key long, row long, {vectors}")
    asked = spark.createDataFrame([("q", 0, ["a", "b"], [0.5, 1.0]), ("q", 1, ["c"], [1.0])], f"query_id string, asked_row long, {vectors}")
    dots = sorted(round(r["dot"], 9) for r in termjoin._exact_scores(pairs, asked, held).collect())
    assert dots == [0.5, 0.5, 1.1]
