"""Top-k against brute force, for every way the two sides can meet."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import vectors
from lexloom.operators import blocks, retrieval, sparse
from lexloom.operators.blocks import Limits, best_cells

SCHEMA = "id long, embedding array<float>, label int"
SMALL_BLOCKS = Limits(broadcast_bytes=2_000)


def unit_rows(n, dim=8, seed=0, start=0):
    values = np.random.default_rng(seed).normal(size=(n, dim))
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    return [(start + i, [float(x) for x in row], i % 3) for i, row in enumerate(values.astype(np.float32))]


def brute_force(queries, corpus, k, decimals=9):
    out = []
    for query_id, q, _ in queries:
        scored = [
            (-round(float(np.dot(np.float64(np.float32(q)), np.float64(np.float32(c)))), decimals), key)
            for key, c, _ in corpus
        ]
        out += [(query_id, rank, key) for rank, (_, key) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(out)


def found(matches):
    return sorted((r["query_id"], r["rank"], r["key"]) for r in matches.rows.collect())


@pytest.mark.parametrize("strategy", ["queries", "corpus", "waves", "auto"])
def test_topk_equals_brute_force(spark, strategy):
    queries, corpus = unit_rows(70, seed=1), unit_rows(230, seed=2, start=1000)
    # A third of the corpus is one vector, so ties decide.
    corpus = [(key, corpus[0][1] if key % 3 == 0 else vector, label) for key, vector, label in corpus]
    matches = retrieval.topk(
        spark.createDataFrame(queries, SCHEMA).repartition(3),
        spark.createDataFrame(corpus, SCHEMA).repartition(5),
        4,
        query_id="id",
        key="id",
        strategy=strategy,
        limits=SMALL_BLOCKS if strategy == "waves" else Limits(),
    )
    assert found(matches) == brute_force(queries, corpus, 4)
    assert matches.at_most == 280


@pytest.mark.parametrize("strategy", ["queries", "corpus", "waves"])
def test_more_than_one_tile_and_string_keys(spark, strategy):
    queries, corpus = unit_rows(3, dim=2, seed=3), unit_rows(5000, dim=2, seed=4)
    named = [(f"k{key:05d}", vector, label) for key, vector, label in corpus]
    matches = retrieval.topk(
        spark.createDataFrame(queries, SCHEMA),
        spark.createDataFrame(named, SCHEMA.replace("id long", "id string")).coalesce(1),
        3,
        query_id="id",
        key="id",
        strategy=strategy,
        limits=Limits(broadcast_bytes=20_000) if strategy == "waves" else Limits(),
    )
    assert found(matches) == brute_force(queries, named, 3)


def test_short_corpus_is_returned_whole_and_null_vectors_never_match(spark):
    queries = unit_rows(2)
    corpus = unit_rows(3, seed=5) + [(99, None, 0)]
    for strategy in ("queries", "corpus", "waves"):
        matches = retrieval.topk(
            spark.createDataFrame(queries, SCHEMA),
            spark.createDataFrame(corpus, SCHEMA),
            10,
            query_id="id",
            key="id",
            strategy=strategy,
        )
        assert found(matches) == brute_force(queries, corpus[:3], 10)


def test_sides_too_large_to_broadcast_go_in_waves(spark):
    queries, corpus = unit_rows(20), unit_rows(40, seed=6)
    tight = Limits(broadcast_bytes=100)
    q, c = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(corpus, SCHEMA)
    matches = retrieval.topk(q, c, 2, query_id="id", key="id", limits=tight)
    assert "Union" in matches.rows._jdf.queryExecution().toString()
    assert found(matches) == brute_force(queries, corpus, 2)
    with pytest.raises(ValueError, match="too large"):
        retrieval.topk(q, c, 2, query_id="id", key="id", strategy="corpus", limits=tight)


@pytest.mark.parametrize("n_queries, n_corpus", [(60, 90), (300, 40), (40, 300)])
def test_many_slices_take_one_shuffle_instead_of_jobs_for_each(spark, n_queries, n_corpus):
    queries, corpus = unit_rows(n_queries, seed=3), unit_rows(n_corpus, seed=4, start=1000)
    corpus = [(key, corpus[0][1] if key % 4 == 0 else vector, label) for key, vector, label in corpus]
    q, c = spark.createDataFrame(queries + [(None, [1.0] * 8, 0)], SCHEMA), spark.createDataFrame(corpus + [(7, None, 0)], SCHEMA)
    named = c.withColumn("id", F.concat(F.lit("k"), F.col("id")))
    context, group = spark.sparkContext, f"many-slices-{n_queries}-{n_corpus}"
    context.setJobGroup(group, group)
    try:
        matches = retrieval.topk(q, named, 3, query_id="id", key="id", strategy="waves", limits=Limits(broadcast_bytes=100))
        rows = found(matches)
    finally:
        context.setJobGroup("", "")
    assert rows == sorted((a, b, f"k{key}") for a, b, key in brute_force(queries, corpus, 3))
    assert len(context.statusTracker().getJobIdsForGroup(group)) < 20


def test_work_beyond_one_task_is_spread(spark):
    queries, corpus = unit_rows(20), unit_rows(40, seed=6)
    q, c = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(corpus, SCHEMA)
    spread = Limits(pairs_per_task=100)
    for strategy in ("queries", "corpus"):
        matches = retrieval.topk(q, c, 2, query_id="id", key="id", strategy=strategy, limits=spread)
        assert found(matches) == brute_force(queries, corpus, 2)


def test_mixed_dimensions_raise(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(Exception, match="different lengths"):
        retrieval.topk(df, df, 1, query_id="id", key="id", strategy="waves").rows.collect()


def test_rows_without_a_key_never_match_and_keys_stay_exact(spark):
    large = 2**53 + 1
    queries = [(large, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    for strategy in ("queries", "corpus", "waves"):
        q, c = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame([*queries, (large + 2, [0.0, 1.0], 0)], SCHEMA)
        matches = retrieval.topk(q, c, 2, query_id="id", key="id", strategy=strategy)
        assert found(matches) == [(large, 1, large), (large, 2, large + 2)]


def test_vectors_that_are_not_finite_raise(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")], 0)], SCHEMA)
    with pytest.raises(Exception, match="NaN"):
        retrieval.topk(df, df, 1, query_id="id", key="id").rows.collect()


def test_a_match_without_a_record_is_kept(spark):
    df = spark.createDataFrame(unit_rows(6), SCHEMA)
    matches = retrieval.topk(df, df, 2, query_id="id", key="id")
    records = df.where("id < 3").selectExpr("id", "'r' AS payload")
    for at_most in (matches.at_most, retrieval.BROADCAST_MATCHES + 1):
        rows = retrieval.attach_records(retrieval.Matches(matches.rows, at_most), records, "id").collect()
        assert len(rows) == 12 and all((r["payload"] is None) == (r["key"] >= 3) for r in rows)


def test_number_of_matches_per_request(spark):
    rows = unit_rows(20)
    df = spark.createDataFrame(rows, SCHEMA)
    asking = df.withColumn("k", (df["id"] % 4).cast("int"))
    matches = retrieval.topk_per_request(asking, df, "k", query_id="id", key="id")
    want = [row for row in brute_force(rows, rows, 3) if row[1] <= row[0] % 4]
    assert found(matches) == want


def test_others_leave_out_the_query_itself(spark):
    rows = unit_rows(30)
    df = spark.createDataFrame(rows, SCHEMA)
    matches = retrieval.topk_others(df, df, 3, query_id="id", key="id")
    expected = []
    for query in rows:
        expected += brute_force([query], [row for row in rows if row[0] != query[0]], 3)
    assert found(matches) == sorted(expected)
    rates = {r["label"]: r for r in retrieval.hit_rate(matches, df, "id", "label").collect()}
    labels = {key: label for key, _, label in rows}
    for label in (0, 1, 2):
        own = [q for q in labels if labels[q] == label]
        hits = sum(any(labels[key] == label for query, _, key in expected if query == q) for q in own)
        assert (rates[label]["queries"], rates[label]["hits"]) == (len(own), hits)


def test_records_join_the_same_with_and_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(unit_rows(20), SCHEMA)
    matches = retrieval.topk(df, df, 3, query_id="id", key="id")
    joined = sorted(map(str, retrieval.attach_records(matches, df, "id").collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_MATCHES", 0)
    assert sorted(map(str, retrieval.attach_records(matches, df, "id").collect())) == joined
    assert len(joined) == 60


def test_best_cells_prefers_the_earlier_column():
    scores = np.array([[1.0, 3.0, 3.0, 3.0], [2.0, -np.inf, -np.inf, np.nan]])
    rows, columns, values = best_cells(scores, 2, 9)
    assert list(zip(rows.tolist(), columns.tolist(), values.tolist())) == [(0, 1, 3.0), (0, 2, 3.0), (1, 0, 2.0)]


def test_best_cells_keep_what_rounds_up_to_the_floor():
    scores = np.array([[0.49996, 0.5, 0.4994, 0.4]])
    rows, columns, values = best_cells(scores, 3, 4, floor=np.array([0.5]))
    assert (columns.tolist(), values.tolist()) == ([0, 1], [0.5, 0.5])


def test_double_precision_only_where_it_matters(monkeypatch):
    rng = np.random.default_rng(11)
    kernel, left = blocks.DenseKernel(), rng.normal(size=(50, 16)).astype(np.float32)
    right = rng.normal(size=(900, 16)).astype(np.float32)
    # Copies tie by position, and vectors a hair apart differ beyond single precision.
    right[::90] = right[0]
    right[1::90] = right[0] * (1 + np.arange(10, dtype=np.float32)[:, None] * np.float32(2e-7))
    left[:5] = right[0]
    none, all_scores = np.full(50, -np.inf), kernel.score(left, right)
    fifth = np.round(np.partition(all_scores[:, :600], -5, axis=1)[:, -5], 9)
    monkeypatch.setattr(kernel, "score", lambda *sides: pytest.fail("all pairs were scored in double precision"))
    for floor in (none, fifth):
        for got, want in zip(kernel.best(left, right, 5, 9, floor), best_cells(all_scores, 5, 9, floor), strict=True):
            np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("scale", [1e-22, 1e17, 1e19])
def test_products_beyond_single_precision(scale):
    rng = np.random.default_rng(12)
    kernel = blocks.DenseKernel()
    left, right = ((rng.normal(size=(n, 4)) * scale).astype(np.float32) for n in (20, 300))
    none, all_scores = np.full(20, -np.inf), kernel.score(left, right)
    for got, want in zip(kernel.best(left, right, 3, 9, none), best_cells(all_scores, 3, 9, none), strict=True):
        np.testing.assert_array_equal(got, want)


def test_every_tile_raises_the_floor_of_a_querys_own_search(spark):
    rng = np.random.default_rng(13)
    floors = []

    class Kernel(blocks.DenseKernel):
        def best(self, left, right, k, decimals, floor):
            floors.append(floor.copy())
            return super().best(left, right, k, decimals, floor)

    search = blocks._Search(Kernel(), 3, 9, "id", "id")
    table = lambda n: pa.table({"id": np.arange(n), "vector": pa.array(list(rng.normal(size=(n, 8)).astype(np.float32)))})
    queries, corpus = table(5), table(3 * blocks.TILE_ROWS)
    (answer,) = search.each_query(search.load([corpus], "id"), [queries])
    scores = np.round(search.kernel.score(*(search.kernel.load(side) for side in (queries, corpus))), 9)
    assert answer["key"].tolist() == np.argsort(-scores, axis=1, kind="stable")[:, :3].ravel().tolist()
    assert np.isneginf(floors[0]).all() and np.isfinite(floors[1]).all() and (floors[2] >= floors[1]).all()


def test_unit_vectors_and_inner_product(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    out = [r[0] for r in df.select(vectors.l2_normalise(F.col("v"))).collect()]
    assert out == [[pytest.approx(0.6), pytest.approx(0.8)], None, None]
    assert df.select(vectors.inner_product(F.col("v"), F.col("v"))).first()[0] == 25.0


# Sparse


def expected_sparse(queries, documents, k):
    import math
    import re
    from collections import Counter

    def counts(body):
        return Counter(token for token in re.split(r"[^a-zé]+", (body or "").lower()) if token)

    docs = {key: counts(body) for key, body in documents}
    df = Counter(term for terms in docs.values() for term in terms)
    idf = {term: math.log((len(docs) + 1) / (n + 1)) for term, n in df.items()}

    def vector(terms):
        weights = {t: n * idf[t] for t, n in terms.items() if idf.get(t, 0) > 0}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    weighted = {key: vector(terms) for key, terms in docs.items()}
    out = []
    for query_id, body in queries:
        q = vector(counts(body))
        scored = [
            (-round(sum(w * d[t] for t, w in q.items() if t in d), 4), key)
            for key, d in weighted.items()
            if q.keys() & d.keys()
        ]
        out += [(query_id, rank, key) for rank, (_, key) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(out)


def sparse_texts(n, seed, hot=False):
    rng = np.random.default_rng(seed)
    words = np.array(["été"] + [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"])
    # The first word occurs in every text; with ``hot`` the second is in most of them.
    texts = []
    for i in range(n):
        picked = list(rng.choice(words[1:], size=rng.integers(1, 12)))
        texts.append((i, " ".join(["Été"] + picked + (["ba"] if hot and i % 5 else []))))
    return texts + [(n, ""), (n + 1, None), (n + 2, "zzz 123")]


@pytest.mark.parametrize("strategy", ["queries", "corpus", "waves", "auto"])
def test_sparse_topk_equals_brute_force(spark, strategy):
    queries, documents = sparse_texts(15, 7), sparse_texts(60, 8, hot=True)
    schema = "id long, text string"
    matches = sparse.topk_by_terms(
        spark.createDataFrame(queries, schema),
        spark.createDataFrame(documents, schema),
        4,
        query_id="id",
        key="id",
        strategy=strategy,
        limits=Limits(broadcast_bytes=100_000) if strategy == "waves" else Limits(),
    )
    assert found(matches) == expected_sparse(queries, documents, 4)


def test_frequent_and_rare_terms_agree(monkeypatch):
    import pyarrow as pa

    from lexloom.operators.blocks import SparseKernel

    rng = np.random.default_rng(9)

    def side(n):
        terms = [sorted(set(rng.choice(list("abcdefghij"), size=5))) for _ in range(n)]
        return pa.table({"terms": terms, "weights": [list(rng.random(len(t))) for t in terms]})

    kernel = SparseKernel()
    left, right = side(30), side(40)
    dots = kernel.score(kernel.load(left), kernel.load(right))
    kernel.products_at_once = 50
    kernel.terms_at_once = 2
    np.testing.assert_allclose(kernel.score(kernel.load(left), kernel.load(right)), dots)
    for i, (a, wa) in enumerate(zip(*left.to_pydict().values())):
        for j, (b, wb) in enumerate(zip(*right.to_pydict().values())):
            exact = sum(w * dict(zip(b, wb)).get(t, 0.0) for t, w in zip(a, wa))
            assert dots[i, j] == (pytest.approx(exact) if exact else -np.inf)


def test_hot_terms_are_split_off_without_changing_vectors(spark):
    df = spark.createDataFrame(sparse_texts(80, 10, hot=True), "id long, text string")
    vocabulary = sparse.build_vocabulary(df, "text")
    plain = sparse.term_vectors(df, "id", "text", vocabulary)
    split = sparse.term_vectors(df, "id", "text", vocabulary, broadcast_bytes=0, hot_terms=3)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_terms_of_one_document_are_not_broadcast(spark, monkeypatch):
    """A vocabulary that is too large for its words but not for those of several documents is still weighed in place."""
    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmn"]
    documents = [(i, f"alle {'eins' if i % 2 else 'zwei'} {words[i]} {words[i + 200]}") for i in range(100)] + [(100, None)]
    queries = [(1, f"eins {words[7]} {words[450]}"), (2, f"zwei {words[204]} unbekannt"), (3, "alle"), (4, words[450])]
    q, d = (spark.createDataFrame(rows, "id long, text string") for rows in (queries, documents))
    vocabulary = sparse.build_vocabulary(d, "text")
    assert vocabulary.repeated_bytes == 36 < 1000 < vocabulary.n_bytes
    monkeypatch.setattr(sparse, "_weigh_counted_by_join", lambda *_: pytest.fail("the documents were weighed by a join"))
    matches = sparse.topk_by_terms(q, d, 4, query_id="id", key="id", vocabulary_bytes=1000)
    assert found(matches) == expected_sparse(queries, documents, 4)


@pytest.mark.parametrize("vocabulary_bytes", [0, 1000, sparse.BROADCAST_BYTES])
def test_documents_are_cut_down_to_the_asked_terms(spark, vocabulary_bytes):
    queries, documents = sparse_texts(3, 14), sparse_texts(90, 15, hot=True)
    q, d = (spark.createDataFrame(rows, "id long, text string") for rows in (queries, documents))
    vocabulary = sparse.build_vocabulary(d, "text")
    asked = sparse.Asked.by(sparse.term_vectors(q, "id", "text", vocabulary))
    whole = {r["id"]: dict(zip(r["terms"], r["weights"])) for r in sparse.term_vectors(d, "id", "text", vocabulary).collect()}
    terms = {t for r in sparse.term_vectors(q, "id", "text", vocabulary).collect() for t in r["terms"]}
    cut = sparse.term_vectors(
        d, "id", "text", vocabulary, broadcast_bytes=vocabulary_bytes, hot_terms=4, asked=asked, counted_from=True
    ).collect()
    want = {key: {t: w for t, w in vector.items() if t in terms} for key, vector in whole.items() if terms & vector.keys()}
    assert {r["id"]: dict(zip(r["terms"], map(pytest.approx, r["weights"]))) for r in cut} == want
    assert any(len(want[key]) < len(whole[key]) for key in want)
    matches = sparse.topk_by_terms(q, d, 4, query_id="id", key="id", vocabulary_bytes=vocabulary_bytes)
    assert found(matches) == expected_sparse(queries, documents, 4)


def test_a_word_in_every_document_or_the_only_document(spark):
    for documents in ([(1, "a b")], [(1, "a b"), (2, "a b")], [(1, None)], []):
        d = spark.createDataFrame(documents, "id long, text string")
        for vocabulary_bytes in (0, 1000):
            assert found(sparse.topk_by_terms(d, d, 4, query_id="id", key="id", vocabulary_bytes=vocabulary_bytes)) == []


def test_term_counts(spark):
    df = spark.createDataFrame([("b a B, c",), ("",), (None,), ("12 x",)], "t string")
    out = df.select(sparse.term_counts(F.col("t")).alias("c")).collect()
    assert [[tuple(e) for e in r["c"] or []] for r in out] == [
        [("a", 1), ("b", 2), ("c", 1)], [], [], [("x", 1)]
    ]
