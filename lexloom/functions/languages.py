"""Language names, their codes, scripts, and the gates that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import is_blank

ENGLISH = "English"
ENGLISH_LOCALE = "en-IN"
UNKNOWN = "unknown"

# Language name -> locale code understood by the translation service.
LOCALES = {
    "English": "en-IN",
    "Hindi": "hi-IN",
    "Tamil": "ta-IN",
    "Telugu": "te-IN",
    "Kannada": "kn-IN",
    "Malayalam": "ml-IN",
    "Bengali": "bn-IN",
    "Marathi": "mr-IN",
    "Gujarati": "gu-IN",
    "Punjabi": "pa-IN",
    "Odia": "or-IN",
}

# ISO code of the language a script decides -> first and last code point
# of the script's Unicode block. Devanagari is shared by Hindi and Marathi; only a
# profile trained on both can part the two.
SCRIPT_BLOCKS = {
    "hi": (0x0900, 0x097F),
    "bn": (0x0980, 0x09FF),
    "pa": (0x0A00, 0x0A7F),
    "gu": (0x0A80, 0x0AFF),
    "or": (0x0B00, 0x0B7F),
    "ta": (0x0B80, 0x0BFF),
    "te": (0x0C00, 0x0C7F),
    "kn": (0x0C80, 0x0CFF),
    "ml": (0x0D00, 0x0D7F),
}
# Full stops of the Devanagari block that other scripts use too.
DANDAS = (0x0964, 0x0965)


def script_pattern(code: str) -> str:
    """A character class of one script, readable by Spark and by RE2."""
    first, last = SCRIPT_BLOCKS[code]
    if first < DANDAS[0] < last:
        return f"[{chr(first)}-{chr(DANDAS[0] - 1)}{chr(DANDAS[1] + 1)}-{chr(last)}]"
    return f"[{chr(first)}-{chr(last)}]"


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.create_map(*entries)[key]


def locale_code(name: Column) -> Column:
    """Locale of a language name; NULL for a name that is not in the table."""
    return _lookup(LOCALES, name)


def iso_code(name: Column) -> Column:
    """Expected ISO code of a language name; empty for English and unknown names."""
    expected = {n: code.split("-")[0] for n, code in LOCALES.items() if n != ENGLISH}
    return F.coalesce(_lookup(expected, name), F.lit(""))


def language_dimension(spark: SparkSession) -> DataFrame:
    """The fixed table ``(name, locale, iso)``, one row per supported language."""
    names = spark.createDataFrame(list(LOCALES.items()), "name string, locale string")
    return names.withColumn("iso", iso_code(F.col("name")))


def is_multilingual(language: Column, has_key: Column | None = None) -> Column:
    """Whether answers are translated, spoken and scored.

    Without ``has_key`` only the language decides, as in the notebook form.
    """
    other = language != ENGLISH
    return other if has_key is None else has_key & other


def needs_translation(text: Column, source: Column, target: Column, has_key: Column | None = None) -> Column:
    """False where the text passes through unchanged: same or unsupported language, blank, or no key."""
    wanted = F.coalesce(source != target, F.lit(False)) & ~is_blank(text)
    return wanted if has_key is None else wanted & has_key


def script_language(text: Column) -> Column:
    """The language whose script has most characters in the text; NULL without such characters.

    One guard pattern keeps texts in other scripts from being scanned per script.
    Ties go to the script listed first.
    """
    any_script = "[" + "".join(script_pattern(code)[1:-1] for code in SCRIPT_BLOCKS) + "]"
    votes = F.array(
        *[
            F.struct(
                F.regexp_count(text, F.lit(script_pattern(code))).alias("n"),
                F.lit(-place).alias("place"),
                F.lit(code).alias("code"),
            )
            for place, code in enumerate(SCRIPT_BLOCKS)
        ]
    )
    return F.when(text.rlike(any_script), F.array_max(votes)["code"])
