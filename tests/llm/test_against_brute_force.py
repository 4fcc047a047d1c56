"""Operators against plain Python on tables of the smallest scale and on built cases."""

import os
import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from lexloom.llm import eliasfano, extraction, linededup, mixing, neardup, ngrams, pieces, repetition, vafile
from lexloom.llm.queries import PIECE_MODEL, REGISTERED
from lexloom.llm.words import split_words
from pyspark.sql import functions as F

from . import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["One two  three", None, "", "two\tone é", "x" * 50]
    whole = split_words(pa.array(texts))
    alone = [h for t in texts for h in split_words(pa.array([t], pa.string())).hashes()]
    assert whole.hashes().tolist() == alone and whole.counts().tolist() == [3, 0, 0, 3, 1]
    assert len(set(alone)) == 5


def family(seed, size=150, copies=25, changes=6):
    """Copies of one text in which some words were replaced, and copies of these."""
    r = random.Random(seed)
    own = [f"w{seed}x{i}" for i in range(size)]
    out = [own]
    for _ in range(copies):
        words = list(r.choice(out))
        for place in r.sample(range(size), r.randint(0, changes)):
            words[place] = f"n{r.random()}"
        out.append(words)
    return [" ".join(w) for w in out]


def test_near_duplicates(spark, documents, texts):
    rows = list(texts)
    passage = " ".join(f"shared{i}" for i in range(40))
    for seed in range(4):
        rows += [(10_000 + 100 * seed + i, t) for i, t in enumerate(family(seed, changes=3 + seed))]
    rows += [(20_000 + i, passage + " " + " ".join(f"own{i}y{j}" for j in range(30))) for i in range(80)]
    rows += [(30_000 + i, " ".join(f"s{j}" for j in range(5 + i // 4))) for i in range(60)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows)
    for rule in (neardup.Rule(), neardup.Rule(short_list=2)):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame, rule=rule).collect()}
        assert got == want


def test_line_dedup(spark, texts):
    r = random.Random(3)
    passage = [f"a passage line {i} with several words" for i in range(8)]
    rows = list(texts)
    for i in range(60):
        own = [f"own line {i} {j}" for j in range(r.randint(0, 6))]
        at, cut = r.randint(0, len(own)), r.randint(0, 3)
        rows.append((5000 + i, "\n".join(own[:at] + passage[cut:] + own[at:])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["text"], x["lines_removed"]) for x in linededup.line_dedup(frame).collect()}
    assert got == brute.line_dedup(rows)
    # whatever stands around it, of a passage only the part that the first copy lacked stays, once
    assert sum(t.count("a passage line 0 ") for t, _ in got.values()) == 1
    assert sum(t.count("a passage line 5 ") for t, _ in got.values()) == 1
    assert all(f"own line {i} {j}" in got[5000 + i][0] for i in range(60) for j in range(5) if f"own line {i} {j}\n" in dict(rows)[5000 + i])


def test_op1_removes_every_repeated_run(spark, texts, tmp_path):
    r = random.Random(5)
    rows = [(k, t) for k, t in texts if t is None or t.count("\n") < 150]
    short = {n: [] for n in (2, 3, 4, 5, 8)}
    for n, keys in short.items():
        for i in range(40):
            passage = [f"passage {n} {i} line {j}" for j in range(n)]
            for copy in range(2):
                own = [f"own {n} {i} {copy} {j}" for j in range(r.randint(0, 5))]
                at = r.randint(0, len(own))
                keys.append(10_000 * n + 2 * i + copy)
                rows.append((keys[-1], "\n".join(own[:at] + passage + own[at:])))
    # few kinds of line, so that runs overlap each other and themselves, and blank stretches of many sizes
    rows += [(i, "\n".join(r.choice(["a", "b", "", "", " ", "c"]) for _ in range(r.randint(1, 14)))) for i in range(200_000, 200_150)]
    rows += [(i, "\n".join([f"x{i}", *[""] * r.randint(0, 6), "y", *[" "] * r.randint(0, 6), f"z{i % 3}"])) for i in range(300_000, 300_040)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["text"], x["lines_removed"]) for x in REGISTERED["op1_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == brute.line_dedup(rows)
    for n, keys in short.items():
        assert all("passage" not in got[k][0] and got[k][1] == n for k in keys[1::2])
        assert all(got[k][1] == 0 for k in keys[::2])


def test_op1_runs_no_python(spark):
    plan = REGISTERED["op1_line_dedup"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_line_dedup_takes_names_and_blank_lines(spark, odd_documents):
    rows = {r["doc_id"]: r for r in linededup.line_dedup(odd_documents).collect()}
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[4]["text"] == " \n\t \n" and rows[6]["lines_removed"] == 3
    assert [rows[k]["lines_removed"] for k in (1, 4, 5, None)] == [0] * 4 and len(rows[5]["text"].split("\n")) == 9000
    blank = "a" + "\n" * 100_000 + "b"
    named = spark.createDataFrame([(1, blank), (2, blank + "\nc")], "doc_id long, text string")
    for name in ("key", "hash", "row", "text_", "lines", "ranges", "stay", "__key", "__left", "a.b"):
        named = named.withColumn(name, F.lit(7))
    found = {r["doc_id"]: r for r in linededup.line_dedup(named).collect()}
    assert found[1]["lines_removed"] == 0 and (found[2]["text"], found[2]["lines_removed"]) == ("c", 100_001)
    assert set(found[1].asDict().values()) == {1, blank, 7, 0}


def test_line_dedup_runs_no_python(spark, documents):
    plan = linededup.line_dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 3}, {"a": 5}, {f"s{i:02}": i * i * i for i in range(1, 30)}, {"x": 0, "y": 9}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(brute.targets(sizes))


def test_top_k(spark):
    r = np.random.default_rng(4)
    vectors = np.floor(256 * r.normal(0, 0.2, (700, 16))).astype(int)
    vectors[100:160] = vectors[100]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(5)
    queries = corpus.where("vec_id % 20 = 0")
    want = {}
    for q in range(0, 700, 20):
        scores = vectors @ vectors[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-scores[i], i))[:5]
        want |= {(q, rank + 1): (i, int(scores[i])) for rank, i in enumerate(best)}
    for bits, wave in ((6, 32 << 20), (1, 2048), (8, 4096)):
        found = vafile.top_k(queries, corpus, 5, bits, wave).collect()
        assert {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in found} == want


def test_repetition(spark, texts):
    odd = ["a a a a", "a b\n\na b\n a b", "ha ha ha\n" * 30, "x y z " * 100 + "\n" + "x y z", "#*$ <b> |", "one\n\n\n two"]
    rows = [(k, t) for k, t in texts if len(t) < 4000] + [(9000 + i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in repetition.repetition_rules(frame).collect()}
    assert got == {k: brute.repetition(t) for k, t in rows}


def test_pieces_have_the_greatest_score_and_decode(texts):
    automaton = pieces.automaton_of(PIECE_MODEL)
    vocabulary, usable = automaton.vocabulary, set(automaton.vocabulary.matched.tolist())
    cases = [t[:300] for _, t in texts[:25]] + ["", "   ", "a  b   c", "\n\n", "▁▁ x▁y", "日本語 текст 🙂", " lead", "trail ", "aaaaaaa b"]
    encoded = pieces.encode(pa.array(cases), automaton)
    assert pieces.decode(encoded, vocabulary).to_pylist() == cases
    for text, ids in zip(cases, encoded.to_pylist(), strict=True):
        total = sum(vocabulary.scores[i] if i in usable else automaton.byte_score for i in ids)
        assert total == pytest.approx(brute.segment(text, vocabulary, automaton.byte_score))


def test_elias_fano():
    r = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 1), (1, 2**50), (1000, 1500), (5000, 2**44), (300, 300)):
        values = np.sort(r.integers(0, universe, n))
        sequence = eliasfano.EliasFano(values, universe)
        assert (sequence.get(np.arange(n)) == values).all()
        asked = np.concatenate((values, r.integers(0, universe, 500)))
        begin = r.integers(0, n + 1, len(asked))
        end = np.minimum(begin + r.integers(0, n + 1, len(asked)), n)
        place = sequence.find_between(begin, end, asked)
        for a, b, value, at in zip(begin, end, asked, place, strict=True):
            inside = np.flatnonzero(values[a:b] == value)
            assert at == (a + inside[0] if len(inside) else -1)


def test_successors_are_searched_below_their_context_alone(monkeypatch):
    r = np.random.default_rng(4)
    n_words = 40
    pairs = np.unique(r.integers(0, n_words * n_words, 300))
    context, word = pairs // n_words, pairs % n_words
    trie = ngrams.Trie(n_words, word, context, np.zeros(n_words), np.zeros(n_words), np.arange(300.0)[: len(pairs)], 65536)
    read = []
    get = eliasfano.EliasFano.get

    def watched(self, index):
        if self is trie.successors:
            read.append(np.array(index))
        return get(self, index)

    monkeypatch.setattr(eliasfano.EliasFano, "get", watched)
    for c in range(n_words):
        read.clear()
        place = trie.pair_places(np.full(n_words, c), np.arange(n_words))
        inside = np.flatnonzero(context == c)
        assert sorted(place[place >= 0]) == inside.tolist() and set(np.concatenate([*read, inside])) <= set(inside)


def test_stretches_of_successors(monkeypatch):
    """A stretch holds the values one by one, and a search for successors of a context decodes none but its own."""
    r = np.random.default_rng(5)
    for n, universe in ((1, 1), (7, 10**12), (500, 700), (3000, 10**6)):
        values = np.sort(r.integers(0, universe, n))
        packed = eliasfano.EliasFano(values, universe)
        assert packed.all().tolist() == values.tolist() == packed.get(np.arange(n)).tolist()
        for begin, end in r.integers(0, n + 1, (40, 2)):
            assert packed.stretch(begin, end).tolist() == values[begin : max(begin, end)].tolist()
    n_words = 60
    code = np.sort(r.choice(n_words * n_words, 400, replace=False))
    context, word = code // n_words, code % n_words
    trie = ngrams.Trie(n_words, word, context, np.zeros(n_words), np.zeros(n_words), np.zeros(len(code)), 65536)
    read = []
    stretch = eliasfano.EliasFano.stretch

    def watched(self, begin, end):
        if self is trie.successors:
            read.append((begin, end))
        return stretch(self, begin, end)

    monkeypatch.setattr(eliasfano.EliasFano, "stretch", watched)
    for c in range(n_words):
        read.clear()
        place = trie.pair_places(np.full(n_words, c), np.arange(n_words))
        inside = np.flatnonzero(context == c)
        assert np.flatnonzero(place >= 0).tolist() == word[inside].tolist() and place[place >= 0].tolist() == inside.tolist()
        assert read == ([(inside[0], inside[-1] + 1)] if len(inside) else [])


def test_texts_of_the_language_model_are_not_shuffled(documents):
    plan = ngrams.score_texts(documents, s=ngrams.Settings(order=3))._jdf.queryExecution().sparkPlan().toString()
    grouped = [line for line in plan.splitlines() if "FlatMap" in line]
    assert len(grouped) >= 5 and not [line for line in grouped if "text#" in line]


def test_what_the_language_model_shuffles_is_small(texts):
    """A part takes less than its texts do when compressed, and a shard's word on common pairs far less than totals."""
    own = [t or "" for _, t in texts]
    count, words = ngrams._hashes(pa.array(own))
    rows = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in texts], "held_out": [False] * len(own), "learned": [True] * len(own)})
    part = pa.Table.from_batches([ngrams._part(3, [rows], [count], [words])])
    found = ngrams._tokens(part)
    assert (found.keys[found.word] == words).all() and found.count.tolist() == [len(t.split()) + 1 for t in own]
    assert part.nbytes < len(pa.Codec("lz4").compress("".join(own).encode()))
    asked = list(ngrams._ask(1)((pa.scalar(3),), iter(part.to_batches())))
    asked += [b.set_column(1, "part", pa.array([4])) for b in asked]
    totals, common = (
        {(b["part"][0].as_py(), b["level"][0].as_py()): b["totals"][0].as_py() for b in ngrams._answer(3, only)((pa.scalar(0),), iter(asked))}
        for only in (False, True)
    )
    assert set(common) == {(3, 2), (4, 2)} and len(totals) == 4
    for key, raw in common.items():
        both = ngrams._from_squeezed(totals[key])
        assert (ngrams._from_squeezed(raw) == (both & np.uint64(1))).all() and 4 * len(raw) < len(totals[key])
    for values in ([], [0], [2**63, 1], [0, 1] * 5000):
        assert ngrams._from_squeezed(ngrams._squeezed(np.array(values, np.uint64))).tolist() == values


def test_a_part_with_other_rows_than_it_asked_for():
    make = lambda words: pa.Table.from_batches([ngrams._part(0, [rows], [np.array([len(words)])], [np.array(words, np.uint64)])])
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "held_out": [False], "learned": [True]})
    asked = list(ngrams._ask(1)((pa.scalar(0),), iter(make([5, 6, 7]).to_batches())))
    common = pa.Table.from_batches(ngrams._answer(3, True)((pa.scalar(0),), iter(asked)))
    run = ngrams._ask_triples(1)
    assert run((pa.scalar(0),), make([5, 6, 7]), common).num_rows == 0
    with pytest.raises(ValueError, match="checkpoint"):
        run((pa.scalar(0),), make([5, 6, 7, 8]), common)


def test_parts_of_the_language_model_do_not_change_it(spark):
    r = random.Random(3)
    rows = [(i % 70 if i % 9 else None, " ".join(r.choices("abcdefgh", k=r.randint(0, 30))) if i % 7 else None) for i in range(200)]
    rows += rows[:40] + [(500, "a b " * 4000), (501, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    s = ngrams.Settings(order=3, part_bytes=900)
    key = lambda row: (repr(row["doc_id"]), row["n_tokens"], row["base_score"], row["score"])
    one, many = (sorted(ngrams.score_texts(frame.repartition(n), s=x).collect(), key=key) for n, x in ((1, ngrams.Settings(order=3)), (7, s)))
    assert len(one) == len(many) == len(rows)
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a["base_score"] == pytest.approx(b["base_score"]) and a["score"] == pytest.approx(b["score"], rel=1e-4)


def test_language_model(documents, texts):
    want = brute.language_model(texts, 500.0)
    for part_bytes in (60_000, 8 << 20):
        for row in ngrams.score_texts(documents, s=ngrams.Settings(part_bytes=part_bytes)).collect():
            n, known, learned, base, score = want[row["doc_id"]]
            assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, learned)
            assert row["base_score"] == pytest.approx(base, rel=1e-9)
            assert abs(row["score"] - score) < 0.02 * n


def test_language_model_of_order_three(spark, texts, tmp_path):
    r = random.Random(8)
    some = r.sample([(k, t) for k, t in texts if len(t or "") < 5000], 60)
    rows = some + [(9000 + i, " ".join(r.choices("abcdef", k=r.randint(0, 12)))) for i in range(150)]
    # words that only held-out texts, only one part or only some parts hold
    rows += [(10_000 + i, f"rare{i // 3} pair{i // 2} once{i // 4} rare{i // 3} pair{i // 2}") for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, shorter = brute.third_order_scores(rows, 3.0, 1.5), brute.language_model(rows, 3.0)
    assert sum(abs(want[k] - shorter[k][4]) > 0.1 for k in want) > 200
    for part_bytes in (2000, 20_000, 8 << 20):
        got = ngrams.score_texts(frame, s=ngrams.Settings(strength=3.0, triple_strength=1.5, part_bytes=part_bytes, order=3)).collect()
        assert len(got) == len(rows)
        for row in got:
            n, known, learned, base, _ = shorter[row["doc_id"]]
            assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, learned)
            assert row["base_score"] == pytest.approx(base, rel=1e-9) and abs(row["score"] - want[row["doc_id"]]) < 1e-3 * n
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute.third_order_scores(rows, 500.0, 3.0)
    for row in REGISTERED["op5_ngram_scores"](spark, str(tmp_path)).collect():
        assert abs(row["score"] - want[row["doc_id"]]) < 1e-4 * row["n_tokens"]
    with pytest.raises(ValueError, match="order"):
        ngrams.Settings(order=4)


def test_order_three_on_odd_rows(odd_documents, no_documents):
    s = ngrams.Settings(order=3)
    rows = ngrams.score_texts(odd_documents, s=s).collect()
    assert len(rows) == 10 and all(np.isfinite(r["score"]) for r in rows)
    assert ngrams.score_texts(no_documents, s=s).count() == 0
    alone = ngrams.score_texts(odd_documents.where("doc_id is null"), s=s).collect()[0]
    assert alone["train_tokens"] == alone["n_known"] == 0 and np.isfinite(alone["score"])


def expected_text(html):
    article = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", article)]
    return "\n".join(b for b in blocks if b)


def test_extraction_of_the_pages(spark):
    found = extraction.extract_text(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    assert len(found) == 50
    for row in found:
        assert row["text"] == expected_text(row["html"]) and row["n_chars"] == len(row["text"])


def test_extraction_on_labelled_pages_it_was_not_fitted_to():
    weights = extraction.default_weights()
    held = [extraction.parse(html) for html in extraction.labelled_pages(150, seed=77)]
    forest = extraction.forest(held)
    content = extraction.marginals(forest, weights)[0][:, 1] > 0.5
    assert (content == forest.keep)[forest.leaf].mean() > 0.99


def test_extraction_of_other_layouts():
    page = (
        '<html><body><div class="top-menu"><a href="1">Home</a> <a href="2">About</a></div><div class="post"><h2>A title</h2>'
        "<p>Some text that goes on&nbsp;and on. It has\n sentences.</p><ul><li>one item of a list</li><li>two</li></ul></div>"
        '<div class="comments"><div class="comment"><p>I think this is a great text and liked it very much.</p></div></div>'
        '<div id="cookie-banner"><p>We use cookies. Accept them please, they are good.</p></div>'
        "<form><p>Sign up for our letters, they are free of charge.</p></form></body></html>"
    )
    assert extraction.main_texts([page], extraction.default_weights()) == [
        "A title\nSome text that goes on and on. It has sentences.\none item of a list\ntwo"
    ]


def test_marginals_are_exact():
    """Message passing against the sum over all states of a small tree."""
    forest = extraction.forest([extraction.parse("<div class='menu'><p>a b</p><p><a href=x>c</a></p></div><h1>t</h1>")])
    r = np.random.default_rng(1)
    weights = extraction.Weights(r.normal(size=(forest.features.shape[1], 2)), r.normal(size=(forest.edge.shape[1], 2, 2)))
    own, pair = forest.features @ weights.node, np.tensordot(forest.edge, weights.edge, axes=1)
    n = len(forest.parent)
    total = np.zeros((n, 2))
    for number in range(2**n):
        state = [number >> i & 1 for i in range(n)]
        score = sum(own[i, state[i]] for i in range(n))
        score += sum(pair[i, state[p], state[i]] for i, p in enumerate(forest.parent) if p >= 0)
        for i in range(n):
            total[i, state[i]] += np.exp(score)
    assert np.allclose(extraction.marginals(forest, weights)[0], total / total.sum(1, keepdims=True))


def test_mixing_meets_its_targets(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(10 + id % 40 as int))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source")
    )
    mixed = mixing.mix_sources(rows)
    per = mixed.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.05 * r["target"] for r in per)
    first, again = ({r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(x).collect()} for x in (rows, rows.repartition(3)))
    assert first == again
