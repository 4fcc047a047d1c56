"""Each operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from lexloom.llm import extraction, linededup, mixing, neardup, ngrams, pieces, quality, repetition, toxicity, vafile
from lexloom.llm.queries import PIECE_MODEL

SMALL = quality.Settings(buckets=256, size=8, hidden=4, epochs=2)


def by_key(df, column="doc_id"):
    return {r[column]: r for r in df.collect()}


def test_line_dedup(odd_documents, no_documents):
    result = linededup.line_dedup(odd_documents)
    assert set(result.columns) == set(odd_documents.columns)
    rows = by_key(result)
    assert result.count() == 10 and rows[2]["text"] is None and rows[3]["text"] == "" and rows[4]["text"] == " \n\t \n"
    assert rows[1]["lines_removed"] == 0 and rows[6]["lines_removed"] > 0 and rows[5]["lines_removed"] == 0
    assert rows[None]["text"] == "A text without a key\nthat has two lines"
    assert linededup.line_dedup(no_documents).count() == 0


def test_quality(odd_documents, no_documents, labels):
    rows = by_key(quality.classify_quality(odd_documents, labels, SMALL))
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[2]["score"] == rows[3]["score"] and rows[None]["held_out"] is False and rows[1]["n"] == 7
    assert quality.classify_quality(no_documents, labels, SMALL).count() == 0
    unlabelled = quality.classify_quality(odd_documents, labels.where("false"), SMALL)
    assert {r["score"] for r in unlabelled.collect()} == {0.5}


def test_pieces(odd_documents, no_documents):
    both = pieces.decode_pieces(pieces.encode_pieces(odd_documents, PIECE_MODEL), PIECE_MODEL)
    for row in both.collect():
        assert row["decoded"] == (row["text"] or "")
    assert by_key(both)[2]["pieces"] == []
    assert pieces.encode_pieces(no_documents, PIECE_MODEL).count() == 0


def test_top_k(spark):
    kind = "vec_id long, vector array<long>"
    rows = [(0, [1, 2]), (1, [1, 2]), (2, [1, 2]), (3, [-1, 0]), (3, [-1, 0]), (4, []), (5, [9, 9, 9])]
    corpus = spark.createDataFrame(rows, kind)
    found = [tuple(r) for r in vafile.top_k(corpus.where("vec_id in (0, 4, 5)"), corpus, k=3).collect()]
    assert sorted(found) == [(0, 1, 1, 5), (0, 2, 2, 5), (0, 3, 3, -1)]
    none = corpus.where("false")
    assert vafile.top_k(none, corpus).count() == vafile.top_k(corpus, none).count() == 0
    # A component of any size changes nothing for other rows; a score beyond 64 bits is the nearest long.
    large = spark.createDataFrame([(6, [2**40, 3]), (7, [2**62, -(2**62)]), (8, [-(2**40), 1])], kind)
    found = [tuple(r) for r in vafile.top_k(corpus.where("vec_id = 0").union(large), corpus.union(large), k=3).collect()]
    assert [r for r in sorted(found) if r[0] == 0] == [(0, 1, 6, 2**40 + 6), (0, 2, 1, 5), (0, 3, 2, 5)]
    assert (7, 1, 6, 2**63 - 1) in found and (6, 1, 7, 2**63 - 1) in found
    many = corpus.where("vec_id = 0")
    for _ in range(3):
        many = many.union(many)
    assert vafile.top_k(many, corpus, k=1, wave_bytes=64).collect()[0]["score"] == 5


def test_language_model(odd_documents, no_documents):
    rows = ngrams.score_texts(odd_documents).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and found[2]["n_tokens"] == found[3]["n_tokens"] == found[4]["n_tokens"] == 1
    assert found[None]["held_out"] is False and found[5]["n_tokens"] == 9000 * 9 + 1
    assert ngrams.score_texts(no_documents).count() == 0
    alone = ngrams.score_texts(odd_documents.where("doc_id is null")).collect()[0]
    assert (alone["n_known"], alone["train_tokens"]) == (0, 0)


def test_extraction(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (4, "<<<>&&amp;<p </"), (5, "<script>x</script>"), (6, "<article>" + "<p>some words here.</p>" * 5000 + "</article>"), (6, "<div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as node")
    found = extraction.extract_text(pages)
    assert set(found.columns) == set(pages.columns)
    texts = {(r["page_id"], r["text"]): r["n_chars"] for r in found.collect()}
    assert (1, "") in texts and (2, "") in texts and (5, "") in texts
    assert texts[6, "\n".join(["some words here."] * 5000)] == 17 * 5000 - 1
    assert extraction.extract_text(pages.where("false")).count() == 0


def test_mixing(odd_documents, no_documents):
    mixed = mixing.mix_sources(odd_documents)
    rows = mixed.collect()
    assert len(rows) == 10 and set(odd_documents.columns) < set(mixed.columns)
    assert all(0 <= r["mix_copies"] <= 3 for r in rows)
    emitted = mixing.emit_copies(mixed)
    assert set(emitted.columns) == set(odd_documents.columns)
    assert emitted.count() == sum(r["mix_copies"] for r in rows)
    assert mixing.mix_sources(no_documents).count() == 0
    silent = mixing.mix_sources(odd_documents.where("doc_id in (2, 3, 4)")).collect()
    assert [(r["mix_target"], r["mix_copies"]) for r in silent] == [(0.0, 1)] * 3


def test_near_duplicates(odd_documents, no_documents):
    rows = neardup.near_duplicates(odd_documents).collect()
    found = {r["id"]: r for r in rows}
    assert len(rows) == 10 and found[6]["component_id"] == 1 and not found[6]["kept"]
    assert (found[2]["n_shingles"], found[2]["component_id"], found[2]["kept"]) == (0, 2, True)
    assert found[None]["component_id"] is None and found[None]["kept"]
    assert (found[7]["n_shingles"], found[7]["component_id"]) == (1, 7)
    assert neardup.near_duplicates(no_documents).count() == 0


def test_repetition(odd_documents, no_documents):
    rows = repetition.repetition_rules(odd_documents).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and found[2]["n_words"] == 0 and found[2]["base_failed"] and not found[2]["kept"]
    assert found[5]["n_words"] == 81000 and found[8]["word_chars"] == len("éü日本語🙂▁x") + odd_documents.where("doc_id = 8").first()["text"].count("\u00a0")
    assert repetition.repetition_rules(no_documents).count() == 0


def test_toxicity(odd_documents, no_documents, labels):
    small = toxicity.Settings(buckets=1024, features=64, rounds=20, least_texts=1)
    rows = by_key(toxicity.classify_toxicity(odd_documents, labels, small))
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[2]["score"] == rows[3]["score"]
    assert toxicity.classify_toxicity(no_documents, labels, small).count() == 0
    assert {r["score"] for r in toxicity.classify_toxicity(odd_documents, labels.where("false"), small).collect()} == {0.5}
