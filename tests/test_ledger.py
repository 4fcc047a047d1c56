"""Calls and their states, column sketches, sentence ends and hard splits, stored language profiles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import language, ledger, sentences, sketches

RESPONSES = "request_key string, status int, attempt int, received long, response string"


def key_of(spark, body):
    payload = F.struct(F.lit(body).alias("input"), F.lit(None).cast("string").alias("mode"))
    return spark.range(1).select(ledger.request_key(payload)).first()[0]


@pytest.fixture(scope="module")
def asked(spark):
    bodies = ["late", "late", "twice", "dead", "bad", "busy", "none", "empty", "then bad"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    payload = F.struct(F.col("body").alias("input"), F.lit(None).cast("string").alias("mode"))
    return ledger.keyed(rows.withColumn("payload", payload))


@pytest.fixture(scope="module")
def states(spark, asked):
    came = [
        ("late", 200, 1, 50, "good"), ("late", 500, 2, 20, None),
        ("twice", 200, 1, 10, "first"), ("twice", 200, 2, 30, "second"), ("twice", 200, 2, 30, "second"),
        ("dead", 500, 1, 1, None), ("dead", 503, 2, 2, None), ("dead", 500, 3, 3, None), ("dead", 500, 3, 3, None),
        ("bad", 400, 1, 1, "good"), ("busy", 429, 1, 1, None), ("empty", 200, 1, 1, ""),
        ("then bad", 200, 1, 1, "good"), ("then bad", 400, 2, 9, None), ("nobody asked", 200, 1, 1, "good"),
    ]
    rows = [(key_of(spark, body), *rest) for body, *rest in came] + [(None, 200, 1, 1, "good")]
    responses = spark.createDataFrame(rows, RESPONSES)
    found = ledger.call_states(asked, responses, F.col("response") != "")
    return found, responses


def test_states(spark, asked, states):
    rows = {r["body"]: (r["state"], r["attempts"], r["last_status"], r["response"]) for r in ledger.responded(asked, states[0]).collect()}
    assert rows == {
        "late": ("answered", 2, 200, "good"),
        "twice": ("answered", 2, 200, "second"),
        "dead": ("dead", 3, 500, None),
        "bad": ("dead", 1, 400, None),
        "busy": ("outstanding", 1, 429, None),
        "none": ("outstanding", 0, None, None),
        "empty": ("outstanding", 1, 200, None),
        "then bad": ("answered", 2, 400, "good"),
    }
    assert ledger.responded(asked, states[0]).count() == 9


def test_what_to_send_again_and_what_is_given_up(spark, asked, states):
    sent = {r["payload"]["input"]: (r["n_requests"], r["attempt"]) for r in ledger.to_send(asked, states[0]).collect()}
    assert sent == {"busy": (1, 2), "none": (1, 1), "empty": (1, 2)}
    dead = {r["body"]: r["attempts"] for r in ledger.dead_letters(asked, states[0]).collect()}
    assert dead == {"dead": 3, "bad": 1}
    assert {r["n_requests"] for r in ledger.calls(asked).collect()} == {1, 2}
    assert ledger.never_asked(asked, states[1]).count() == 2
    more = ledger.call_states(asked, states[1], F.col("response") != "", max_attempts=4)
    assert "dead" in {r["payload"]["input"] for r in ledger.to_send(asked, more).collect()}


def test_equal_payloads_are_one_call_whatever_they_leave_out(spark):
    typed = lambda mode: F.struct(F.lit("x").alias("input"), F.lit(mode).cast("string").alias("mode"))
    keys = spark.range(1).select(*[ledger.request_key(typed(m)).alias(f"k{i}") for i, m in enumerate((None, None, "formal"))]).first()
    assert keys[0] == keys[1] != keys[2]


def test_merged_sketches_describe_the_whole(spark):
    r = random.Random(1)
    values = [(i % 7, r.randint(0, 40_000) if i % 10 else None, r.choice("abc") * (i % 5), [i % 3]) for i in range(60_000)]
    df = spark.createDataFrame(values, "part int, n int, s string, a array<int>").repartition(4)
    parts = sketches.column_sketches(df, by=["part"])
    assert parts.count() == 7 * 3
    merged = sketches.merge_sketches(sketches.sketches_of_parts([parts.where("part < 3"), parts.where("part >= 3")]))
    figures = {(f["column"], f["statistic"]): f["value"] for f in sketches.sketch_figures(merged, (0.1, 0.5)).collect()}
    numbers = sorted(n for _, n, _, _ in values if n is not None)
    assert figures["n", "rows"] == "60000" and figures["n", "num_nulls"] == "6000"
    assert (figures["n", "min"], figures["n", "max"]) == (str(numbers[0]), str(numbers[-1]))
    assert abs(int(figures["n", "distinct_count"]) - len(set(numbers))) <= 0.04 * len(set(numbers))
    assert figures["s", "distinct_count"] == "13" and figures["a", "distinct_count"] == "3" and ("s", "quantile_0.5") not in figures
    for q in (0.1, 0.5):
        got = float(figures["n", f"quantile_{q:g}"])
        assert abs(sum(n <= got for n in numbers) / len(numbers) - q) < 0.02
    per_part = sketches.sketch_figures(sketches.merge_sketches(parts, by=["part"]), by=["part"])
    assert per_part.where("column = 'n' AND statistic = 'rows'").count() == 7


def test_abbreviations_are_learned(spark):
    body = "Mr. smith met Dr. jones at no. 5 today. The law applies. He said so. It applies. The end. "
    docs = spark.createDataFrame([(body * 6,), ("the law of mr. smith. " * 3,), (None,), ("",)], "t string")
    counts = sentences.abbreviation_counts(docs, "t")
    halves = counts.unionByName(sentences.abbreviation_counts(docs.where("false"), "t"))
    known = [r["word"] for r in sentences.abbreviations(halves, sentences.Evidence(goes_on=0.9)).collect()]
    assert known == ["mr", "dr", "no"]
    ends = sentences.end_pattern(known)
    found = spark.createDataFrame([("Mr. Smith met Dr. Jones. J. Doe left! “Why?” He asked. see no. 5 e.g. here. यह है। वह था॥अंत",)], "t string")
    assert found.select(sentences.sentences(F.col("t"), ends)).first()[0] == [
        "Mr. Smith met Dr. Jones.", "J. Doe left!", "“Why?”", "He asked. see no. 5 e.g. here.", "यह है।", "वह था॥", "अंत",
    ]
    chunks = found.select(text.sentence_chunks(F.col("t"), 40, ends=ends)).first()[0]
    assert chunks[0] == "Mr. Smith met Dr. Jones. J. Doe left!" and chunks[-1].endswith("अंत")
    long_ = found.select(text.paragraph_chunks(F.col("t"), 30, ends=ends)).first()[0]
    assert long_[0] == "Mr. Smith met Dr. Jones."


TEXTS = ["a" * 25, "कि" * 13 + ". " + "b" * 9, "e" + "́" * 30, "x. " * 9, "", "word " * 7 + "\n" + "é" * 11, "👩‍👩‍👧" * 4]


def test_hard_splits_keep_marks_with_their_characters(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    cut = df.select("t", text.hard_split(F.col("t"), 10).alias("c")).collect()
    for r in cut:
        assert "".join(r["c"]) == r["t"] and all(0 < len(c) <= 10 for c in r["c"])
    by_text = {r["t"]: r["c"] for r in cut}
    assert all(not re.match("[ि‍]", c) for t in (TEXTS[1], TEXTS[6]) for c in by_text[t])
    for chunks in (text.paragraph_chunks(F.col("t"), 10, hard=True), text.sentence_chunks(F.col("t"), 10, hard=True)):
        assert all(len(c) <= 10 for r in df.select(chunks.alias("c")).collect() for c in r["c"])
    whole = df.select(text.paragraph_chunks(F.col("t"), 10).alias("c")).collect()
    assert whole[0]["c"] == [TEXTS[0]]  # without the option a sentence stays whole


def test_profiles_are_kept_and_counts_add_up(spark, tmp_path):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house of cards", "en"), ("la maison", "fr"), ("x", None)]
    df = spark.createDataFrame(rows, "t string, l string")
    store = language.ProfileStore(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        store.build()
    store.learn("one", df.limit(2), "t", "l", ["en", "fr"])
    store.learn("two", df.where("l = 'en'"), "t", "l", ["en"])
    store.learn("two", df.where("t LIKE '%house%' OR t LIKE '%maison%'"), "t", "l", ["en", "fr"])  # learned again, not twice
    assert store.batches() == ["one", "two"] and store.build(top_n=5) == 0
    trained = language.train_profile(df, "t", "l", ["en", "fr"], top_n=5)
    loaded = language.ProfileStore(spark, str(tmp_path / "p")).load()
    assert loaded.languages == trained.languages
    assert sorted(map(tuple, loaded.rows.collect())) == sorted(map(tuple, trained.rows.collect()))
    assert store.build(top_n=2) == 1 and store.load(0).rows.count() == loaded.rows.count() > store.load().rows.count()
