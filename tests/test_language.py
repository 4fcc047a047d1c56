import pytest
from pyspark.sql import functions as F

from lexloom.functions import languages
from lexloom.operators import language

TEXTS = {
    "en": "the cat and the dog went to the house with the other animals that they had seen",
    "fr": "le chat et le chien sont dans la maison avec les autres animaux que nous avons vus",
    "hi": "यह एक किताब है और वह मेरे घर में रहता है और मैं भी वहाँ रहता हूँ",
    "mr": "हे एक पुस्तक आहे आणि तो माझ्या घरात राहतो आणि मी पण तिथे राहते",
}


@pytest.fixture(scope="module")
def profile(spark):
    rows = [(TEXTS[code], code) for code in ("en", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    return language.train_profile(df, "text", "lang", ["fr", "en"])


def detect(spark, profile, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["detected"] for r in language.detect_language(df, "i", "text", profile).orderBy("i").collect()]


def test_known_grams_decide_and_others_are_unknown(spark, profile):
    texts = ["the animals that went", "les animaux que nous avons", "12345", "", None, "ab", "qqqq"]
    assert detect(spark, profile, texts) == ["en", "fr"] + ["unknown"] * 5


@pytest.mark.parametrize(
    "text, code",
    [
        ("यह हिंदी है।", "hi"), ("இது தமிழ்", "ta"), ("ఇది తెలుగు", "te"), ("ಇದು ಕನ್ನಡ", "kn"),
        ("ഇത് മലയാളം", "ml"), ("এটি বাংলা।", "bn"), ("આ ગુજરાતી છે", "gu"), ("ਇਹ ਪੰਜਾਬੀ ਹੈ।", "pa"),
        ("ଏହା ଓଡ଼ିଆ।", "or"),
    ],
)
def test_scripts_decide(spark, text, code):
    assert spark.range(1).select(languages.script_language(F.lit(text))).first()[0] == code


def test_script_comes_before_the_profile_and_dandas_do_not_vote(spark, profile):
    assert detect(spark, profile, ["the cat and the dog தமிழ்", "the cat।"]) == ["ta", "en"]


def test_hindi_and_marathi_are_parted_by_a_profile_of_both(spark):
    df = spark.createDataFrame([(t, code) for code, t in TEXTS.items()], "text string, lang string")
    both = language.train_profile(df, "text", "lang", ["en", "hi", "mr"])
    assert detect(spark, both, ["और वह मेरे घर में है", "आणि तो माझ्या घरात आहे", "the cat"]) == ["hi", "mr", "en"]


def test_profile_matches_a_plain_count(spark, profile):
    import math
    from collections import Counter

    counts = {c: Counter(TEXTS[c][i : i + 3] for i in range(len(TEXTS[c]) - 2)) for c in ("en", "fr")}
    rows = {r["gram"]: r for r in profile.rows.collect()}
    assert rows.keys() == counts["en"].keys() | counts["fr"].keys()
    for gram, row in rows.items():
        for code in ("en", "fr"):
            exact = math.log((counts[code][gram] + 0.5) / sum(counts[code].values()))
            assert row[f"log_{code}"] == round(exact * 1_000_000)


def test_profile_keeps_the_most_frequent_grams(spark):
    df = spark.createDataFrame([("abcabcabcxyz", "en"), ("zzzz", "other")], "text string, lang string")
    rows = language.train_profile(df, "text", "lang", ["en"], top_n=2).rows.collect()
    assert {r["gram"] for r in rows} == {"abc", "bca"}


def test_scores_and_reports(spark):
    rows = [(1, "Hindi", "hi"), (2, "Hindi", "en"), (3, "English", "en"), (4, "Klingon", "unknown")]
    df = spark.createDataFrame(rows, "i int, language string, detected string")
    scored = language.score_by_language_name(df, "language")
    assert {r["i"]: (r["expected"], r["score"], r["composite"], r["language_detection"]) for r in scored.collect()} == {
        1: ("hi", 1.0, 100, 100), 2: ("hi", 0.0, 0, 0), 3: ("", 0.0, 0, 0), 4: ("", 0.0, 0, 0)
    }
    report = {r["expected"]: tuple(r)[1:] for r in language.language_report(scored).collect()}
    assert report == {"hi": (2, 1, 0, 50.0), "": (2, 0, 1, 0.0)}
    assert language.confusion(scored).count() == 4


def test_language_tables_and_gates(spark):
    dimension = {r["name"]: (r["locale"], r["iso"]) for r in languages.language_dimension(spark).collect()}
    assert len(dimension) == 11
    assert dimension["English"] == ("en-IN", "") and dimension["Odia"] == ("or-IN", "or")
    df = spark.createDataFrame(
        [("Hindi", True), ("Hindi", False), ("English", True), ("Latin", True)], "language string, key boolean"
    )
    out = df.select(
        languages.locale_code(F.col("language")),
        languages.is_multilingual(F.col("language"), F.col("key")),
        languages.is_multilingual(F.col("language")),
    ).collect()
    assert [tuple(r) for r in out] == [
        ("hi-IN", True, True), ("hi-IN", False, True), ("en-IN", False, False), (None, True, True)
    ]
