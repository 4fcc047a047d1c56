import json

from pyspark.sql import functions as F

from lexloom.functions import hints, responses
from lexloom.operators import context, requests


def test_inputs_resolve_and_blank_ones_are_marked(spark):
    rows = [(1, " typed ", None), (2, "typed", ""), (3, "typed", " said"), (4, " 　", None), (5, None, None)]
    df = spark.createDataFrame(rows, "i int, typed string, said string")
    out = requests.resolve_requests(df, "typed", "said")
    assert [(r["resolved"], r["accepted"]) for r in out.orderBy("i").collect()] == [
        ("typed", True), ("typed", True), (" said", True), ("", False), ("", False)
    ]
    assert (requests.accepted(out).count(), requests.rejected(out).count()) == (3, 2)
    untrimmed = requests.resolve_requests(df, "typed", "said", trim_typed=False, reject_blank=False)
    assert [r["resolved"] for r in untrimmed.orderBy("i").collect()][0] == " typed "
    assert requests.accepted(untrimmed).count() == 5


def test_translation_requests_are_routed(spark):
    rows = [
        (1, "one\ntwo", "hi-IN", "en-IN"), (2, "x" * 600 + "\n" + "y" * 600, "en-IN", "ta-IN"),
        (3, "same", "en-IN", "en-IN"), (4, " \n ", "hi-IN", "en-IN"), (5, None, "hi-IN", "en-IN"),
    ]
    df = spark.createDataFrame(rows, "i int, t string, s string, g string")
    sent = requests.translation_requests(df, "i", "t", F.col("s"), F.col("g"))
    bodies = [(r[0], r[1], json.loads(r[2])) for r in
              sent.select("i", "chunk_no", F.to_json("payload")).orderBy("i", "chunk_no").collect()]
    assert bodies[0] == (1, 0, {
        "input": "one\ntwo", "source_language_code": "hi-IN", "target_language_code": "en-IN",
        "speaker_gender": "Female", "mode": "formal", "model": "mayura:v1", "enable_preprocessing": True,
    })
    assert [(i, n, b["input"]) for i, n, b in bodies[1:]] == [(2, 0, "x" * 600), (2, 1, "y" * 600)]
    assert bodies[1][2].keys() == {
        "input", "source_language_code", "target_language_code", "model", "enable_preprocessing"
    }
    assert requests.translation_requests(df, "i", "t", F.col("s"), F.col("g"), F.lit(False)).count() == 0


def test_speech_requests_keep_the_first_chunks(spark):
    body = ". ".join(f"{i}" * 400 for i in range(5))
    df = spark.createDataFrame([(1, body), (2, "..."), (3, "short")], "i int, t string")
    out = {r["i"]: r for r in requests.speech_requests(df, "i", "t", F.lit("hi-IN")).collect()}
    assert out.keys() == {1, 3}
    assert (len(out[1]["payload"]["inputs"]), out[1]["n_dropped"]) == (3, 2)
    assert out[3]["payload"].asDict() == {
        "inputs": ["short."], "target_language_code": "hi-IN", "speaker": "anushka", "pitch": 0, "pace": 1.0,
        "loudness": 1.5, "speech_sample_rate": 8000, "enable_preprocessing": True, "model": "bulbul:v2",
    }
    assert requests.speech_requests(df, "i", "t", F.lit("hi-IN"), max_chunks=6).where("n_dropped > 0").count() == 0


def test_responses(spark):
    rows = [
        ('{"choices":[{"message":{"content":"hello"}},{"message":{"content":"no"}}]}', "hello"),
        ('{"choices":[]}', None), ("{}", None), ("not json", None), (None, None),
    ]
    df = spark.createDataFrame(rows, "r string, e string")
    assert all(r[0] == r[1] for r in df.select(responses.chat_content(F.col("r")), "e").collect())
    one = spark.createDataFrame(
        [('{"translated_text":"t","transcript":"s","audios":["a","b"]}',), ("{}",), ("broken",)], "r string"
    ).select(
        responses.translated_text(F.col("r"), F.lit("source")), responses.transcript(F.col("r")),
        responses.audios(F.col("r")),
    )
    assert [tuple(r) for r in one.collect()] == [
        ("t", "s", ["a", "b"]), ("source", "", []), ("source", "", [])
    ]


def test_context_lines_follow_rank(spark):
    rows = [(1, 2, "85", "Cruelty", "b" * 400), (1, 1, "80", "Dowry death", None), (2, 1, "303", None, "c")]
    df = spark.createDataFrame(rows, "query_id int, rank int, key string, name string, text string")
    out = {r["query_id"]: r for r in context.retrieval_context(df.repartition(3), "key", "name", "text").collect()}
    assert out[1]["context"] == f"- Section 80 (Dowry death): …\n- Section 85 (Cruelty): {'b' * 300}…"
    assert (out[1]["n_sections"], out[2]["context"]) == (2, "- Section 303 (): c…")


def test_hint_block_keeps_declared_order(spark):
    block = hints.hint_block(hints.hint_dimension(spark).repartition(4)).first()[0].split("\n")
    assert len(block) == 16
    assert block[0] == "- Theft: Chapter 17 — BNS Sections 303-305"
    assert block[-1] == "- Dowry Death: Chapter 5  — BNS Section 80"


def test_chat_requests(spark):
    asked = spark.createDataFrame([(1, "My bike is gone"), (2, "Nothing found")], "id int, t string")
    found = spark.createDataFrame([(1, 1, "- Section 303")], "query_id int, n_sections int, context string")
    rows = context.message_rows(context.guidance_requests(asked, found, "id", "t")).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["pos"], r["role"], r["max_tokens"]) for r in rows] == [
        (1, 0, "system", 1200), (1, 1, "user", 1200), (2, 0, "system", 1200), (2, 1, "user", 1200)
    ]
    parts = rows[1]["content"].split("\n\n")
    assert parts[0] == "Incident: My bike is gone" and parts[1].endswith("\n- Section 303")
    assert len(parts[2].split("\n")) == 17
    assert "\n\nSections found:\n\n\nOffense reference:\n- Theft" in rows[3]["content"]
    explained = context.explanation_requests(asked, "id", "t").first()
    assert explained["max_tokens"] == 1024 and explained["messages"][1]["content"].endswith("\n\nMy bike is gone")
