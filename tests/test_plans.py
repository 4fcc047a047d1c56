"""Whole jobs: index, guidance with service responses as tables, and the stream against the batch."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexloom.functions.hints import OFFENSES
from lexloom.operators import language, retrieval
from lexloom.plans import guidance as plan
from lexloom.plans.index import build_index
from lexloom.plans.search import retrieve
from lexloom.sources.vectors import read_embedding_table
from lexloom.streaming.retrieval import stream_guidance, stream_topk

# The stand-in model below runs on the workers, which cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECTIONS = [
    ("303", "Theft", "Whoever takes a bicycle or other property without consent"),
    ("80", "Dowry death", "Where the death of a wife follows cruelty for dowry"),
    ("318", "Cheating", "Whoever deceives a person and takes bank money"),
]
WORDS = ["bicycle", "property", "dowry", "wife", "bank", "money"]


def load_word_model():
    def encode(texts):
        return np.array([[body.lower().count(word) for word in WORDS] for body in texts])

    return encode


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "vectors")
    sections = spark.createDataFrame(
        SECTIONS + [("999", "Empty", "no known word")], "Section string, Section_name string, Description string"
    )
    assert build_index(sections, path, load_word_model, batch_size=2) == {
        "stored": 3, "rejected": 1, "dimension": 6
    }
    return read_embedding_table(spark, path)


def embedded(df, text):
    from lexloom.operators.embed import embed_texts

    return embed_texts(df, text, load_word_model)


def test_smoke_queries_find_their_section(spark, corpus):
    asked = spark.createDataFrame(
        [(1, "someone stole my bicycle"), (2, "my wife and dowry"), (3, "bank money is gone")], "q int, t string"
    )
    found = retrieve(asked, corpus, load_word_model, 1, query_id="q", text="t", key="Section").collect()
    assert {r["query_id"]: (r["key"], r["Section_name"]) for r in found} == {
        1: ("303", "Theft"), 2: ("80", "Dowry death"), 3: ("318", "Cheating")
    }
    assert all(0 < r["similarity"] <= 1 and r["rank"] == 1 for r in found)


def test_requests_become_scored_answers(spark, corpus):
    requests = spark.createDataFrame(
        [
            ("r1", "English", True, " my bicycle "),
            ("r2", "Hindi", True, ""),
            ("r3", "Hindi", False, "dowry"),
            ("r4", "Tamil", True, "  "),
        ],
        "request_id string, language string, has_key boolean, typed string",
    )
    heard = spark.createDataFrame(
        [("r2", '{"transcript":"साइकिल"}'), ("r4", "failed")], "request_id string, response string"
    )
    prepared = plan.prepare_requests(plan.attach_transcripts(requests, heard))
    sent = plan.inputs_to_translate(prepared)
    assert [(r["request_id"], r["payload"]["input"]) for r in sent.collect()] == [("r2", "साइकिल")]

    answered = spark.createDataFrame(
        [("r2", 0, '{"translated_text":"bicycle"}')], "request_id string, chunk_no int, response string"
    )
    english = plan.english_inputs(prepared, sent, answered)
    assert {r["request_id"]: r["translated"] for r in english.collect()} == {
        "r1": "my bicycle", "r2": "bicycle", "r3": "dowry"
    }

    chats = plan.guidance(
        embedded(english, "translated"), corpus, "Section", "Section_name", "Description", k=2
    ).collect()
    users = {r["query_id"]: r["messages"][1]["content"] for r in chats}
    assert users.keys() == {"r1", "r2", "r3"}
    assert users["r2"].split("\n\n")[1].split("\n")[1].startswith("- Section 303 (Theft)")
    assert users["r3"].split("\n\n")[1].split("\n")[1].startswith("- Section 80 (Dowry death)")
    assert users["r1"].count("\n- ") == 2 + len(OFFENSES)

    replies = [(r, json.dumps({"choices": [{"message": {"content": f"Step one.\nStep two {r}"}}]}))
               for r in ("r1", "r2", "r3")]
    reply = plan.answers(prepared, spark.createDataFrame(replies, "request_id string, response string"))
    back = plan.answers_to_translate(reply)
    assert [r["request_id"] for r in back.collect()] == ["r2"]
    final = plan.final_answers(
        reply, back,
        spark.createDataFrame([("r2", 0, '{"translated_text":"पहला कदम"}')],
                              "request_id string, chunk_no int, response string"),
    )
    assert {r["request_id"]: r["translated"] for r in final.collect()} == {
        "r1": "Step one.\nStep two r1", "r2": "पहला कदम", "r3": "Step one.\nStep two r3"
    }
    trained = language.train_profile(
        spark.createDataFrame([("the step is one", "en")], "t string, l string"), "t", "l", ["en"]
    )
    scores = plan.score_answers(final, trained).collect()
    assert [(r["request_id"], r["detected"], r["expected"], r["composite"]) for r in scores] == [
        ("r2", "hi", "hi", 100)
    ]
    spoken = plan.answers_to_speak(final).collect()
    assert [(r["request_id"], r["payload"]["inputs"], r["payload"]["target_language_code"]) for r in spoken] == [
        ("r2", ["पहला कदम."], "hi-IN")
    ]
    assert plan.explanations(prepared).count() == 3


def test_unanswered_requests_stay_with_their_status(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    replies = [("a", '{"choices":[{"message":{"content":"yes"}}]}'), ("b", "failed")]
    found = plan.answers(asked, spark.createDataFrame(replies, "request_id string, response string"))
    assert sorted((r["request_id"], r["answer"], r["status"]) for r in found.collect()) == [
        ("a", "yes", "answered"), ("b", None, "empty"), ("c", None, "missing"),
    ]


def test_missing_responses_keep_the_source_chunk(spark):
    texts = spark.createDataFrame([("a", "x" * 800 + "\n" + "y" * 800)], "request_id string, t string")
    from lexloom.operators.requests import translation_requests

    sent = translation_requests(texts, "request_id", "t", F.lit("en-IN"), F.lit("hi-IN"))
    replies = spark.createDataFrame([("a", 1, '{"translated_text":"Z"}')],
                                    "request_id string, chunk_no int, response string")
    out = plan.apply_translations(texts, "request_id", "t", sent, replies).first()
    assert out["translated"] == "x" * 800 + "\nZ"


def test_texts_wait_for_calls_that_failed(spark):
    from lexloom.operators import ledger
    from lexloom.operators.requests import translation_requests

    line = lambda c: c * 800
    texts = spark.createDataFrame(
        [("a", line("x") + "\n" + line("y")), ("b", line("x")), ("c", line("z")), ("d", ""), ("e", line("w"))], "request_id string, t string"
    )
    sent = translation_requests(texts, "request_id", "t", F.lit("en-IN"), F.lit("hi-IN"))
    keys = {r["payload"]["input"][0]: r["request_key"] for r in ledger.keyed(sent).collect()}
    came = [(keys["x"], 503, 1, 1, None), (keys["x"], 200, 2, 2, '{"translated_text":"X"}'), (keys["z"], 400, 1, 1, None), (keys["y"], 429, 1, 1, None)]
    responses = spark.createDataFrame(came, "request_key string, status int, attempt int, received long, response string")
    done = plan.apply_translation_calls(texts, "request_id", "t", sent, responses)
    rows = {r["request_id"]: (r["translated"][:3], r["n_untranslated"], r["status"]) for r in done.texts.collect()}
    assert rows == {"a": ("X\ny", 1, "waiting"), "b": ("X", 0, "done"), "c": ("zzz", 1, "failed"), "d": ("", 0, "done"), "e": ("www", 1, "waiting")}
    assert {(r["payload"]["input"][0], r["attempt"]) for r in done.to_send.collect()} == {("y", 2), ("w", 1)}
    assert [r["request_id"] for r in done.given_up.collect()] == ["c"]


def test_stream_equals_batch_and_replays_do_not_duplicate(spark, tmp_path):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(60, 4)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3, "id").write.parquet(source)

    def run(state):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_topk(stream, lambda: df, out, str(tmp_path / state), k=3, query_id="id", key="id").awaitTermination()
        return sorted(map(str, spark.read.parquet(out).drop("batch_id").collect()))

    batch = sorted(map(str, retrieval.topk(df, df, 3, query_id="id", key="id").rows.collect()))
    assert run("state") == batch
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3
    assert run("another state") == batch


def test_guidance_stream(spark, corpus, tmp_path):
    asked = spark.createDataFrame([("q1", "my bicycle"), ("q2", "bank")], "request_id string, translated string")
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    stream_guidance(
        stream, lambda: corpus, lambda batch: embedded(batch, "translated"), str(tmp_path / "out"),
        str(tmp_path / "state"), key="Section", name="Section_name", text="Description", k=1,
    ).awaitTermination()
    users = {r["query_id"]: r["messages"][1]["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "- Section 303 (Theft)" in users["q1"] and "- Section 318 (Cheating)" in users["q2"]
