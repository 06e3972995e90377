"""Quality rules: distribution divergence from language references. DataFrame functions only.

Counts that hold for any text come first (words, symbols, repeated lines and word windows). The method compares
two histograms of a document with fixed references and takes the Jensen-Shannon distance (base 2, so 0 to 1) to
the nearest: character classes (lower-case and caseless letters, upper case, punctuation, symbols, white space;
digits stand aside, since numbers say nothing about prose) and the language's most common words, all others
together. A document is rejected if its classes are far from every reference, if its common words are very far,
if both are somewhat far, or if it lacks common words; documents too short for a distribution are exempt. A text
with none of the listed words has a distance of 0.338. A language without a reference has none of them either, but
short words of its own that come again and again: Latin text lacks common words only if it has few of those too,
and other scripts are exempt.

Equal word windows are found by the 64-bit hash of five word hashes.

Defined results: a null text has no words, fails the base rules and is not kept; an empty text likewise; null
ids and repeated rows are kept apart; an empty table gives no rows; other columns, whatever their names, pass by
in `filter_documents` and are not read by `assess`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: shares of the character classes in running text: letters, upper case, punctuation, symbols, white space
CLASSES = {
    "alphabetic": (0.795, 0.03, 0.025, 0.0005, 0.1495),
    "capitalising nouns": (0.785, 0.06, 0.025, 0.0005, 0.1295),
    "caseless": (0.815, 0.0005, 0.025, 0.0005, 0.159),
    "without spaces": (0.90, 0.005, 0.075, 0.0005, 0.0195),
}
#: shares of the commonest words in running text, in per cent
WORDS = {
    "en": {"the": 6.0, "of": 3.2, "and": 2.7, "to": 2.4, "a": 2.1, "in": 1.9, "is": 1.0, "that": 1.0, "it": 0.9, "for": 0.9, "was": 0.8, "on": 0.7, "with": 0.7, "as": 0.6},
    "de": {"der": 3.6, "die": 3.5, "und": 2.8, "in": 1.9, "den": 1.3, "von": 1.1, "zu": 1.1, "das": 1.1, "mit": 0.9, "sich": 0.8, "des": 0.8, "auf": 0.7, "ist": 0.8, "nicht": 0.7},
    "fr": {"de": 5.0, "la": 3.1, "le": 2.3, "et": 2.2, "les": 1.9, "des": 1.6, "en": 1.3, "un": 1.1, "du": 1.1, "une": 0.9, "que": 0.8, "pour": 0.7, "est": 0.8, "dans": 0.7},
    "es": {"de": 5.8, "la": 3.6, "que": 2.7, "el": 2.6, "en": 2.4, "y": 2.2, "los": 1.6, "se": 1.1, "las": 1.0, "del": 1.0, "un": 0.9, "por": 0.8, "con": 0.8, "no": 0.8},
}
LIST = sorted({w for words in WORDS.values() for w in words})
LETTER_GUARD, WORD_GUARD = 200, 100
CLASS_LIMIT, WORD_LIMIT, BOTH = 0.17, 0.65, (0.13, 0.5)
#: a Latin text lacks common words above this distance and below this share of repeated words of one to four letters
LACK_LIMIT, SHORT_SHARE = 0.32, 0.04


def words_of(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def divergence(p: Column, q: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of a share array to a constant one; shares of zero add nothing."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        own = F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return own + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    terms = F.zip_with(p, F.array(*map(F.lit, q)), term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


def _shares(counts: list[Column]) -> Column:
    total = sum(counts[1:], counts[0]).cast("double")
    return F.when(total > 0, F.array(*(c / total for c in counts))).otherwise(F.array(*(F.lit(0.0) for _ in counts)))


def repeated_words(hashes: Column, width: int = 5) -> dict[str, Column]:
    """Steps to the number of words in windows found twice or more; each uses the columns of those before."""
    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, width))))
    # the hash and place of each window, sorted by hash: those beside an equal hash are repeated
    placed = F.when(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    col = F.col("q_placed")
    again = F.sort_array(
        F.transform(F.filter(col, lambda s, j: (s["h"] == F.get(col, j + 1)["h"]) | ((j > 0) & (s["h"] == F.get(col, F.greatest(j - 1, F.lit(0)))["h"]))), lambda s: s["i"])
    )
    at = F.col("q_again")
    # each place covers the words up to the next place, five at most
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(width)), F.lit(width))), F.lit(0), lambda a, b: a + b)
    return {"q_windows": windows, "q_placed": placed, "q_again": again, "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}


def _features(df: DataFrame) -> DataFrame:
    """df has q_text; adds the counts and the verdict."""
    df = df.withColumn("q_words", words_of(F.col("q_text")))
    df = df.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count("q_text", F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "q_lines": F.filter(F.split("q_text", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != ""),
            "q_upper": F.coalesce(F.regexp_count("q_text", F.lit(r"\p{Lu}")), F.lit(0)).cast("long"),
            "q_digits": F.coalesce(F.regexp_count("q_text", F.lit("[0-9]")), F.lit(0)).cast("long"),
            "q_points": F.coalesce(F.regexp_count("q_text", F.lit(r"[\p{P}&&[^#*%&]]")), F.lit(0)).cast("long"),
            "q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)),
            "q_common": F.filter(F.transform("q_words", lambda w: F.lower(w)), lambda w: w.isin(*LIST)),
        }
    )
    for name, step in repeated_words(F.col("q_hashes")).items():
        df = df.withColumn(name, step)
    size = F.size("q_common")
    df = df.withColumn("n_dup_lines", F.coalesce(F.size("q_lines") - F.size(F.array_distinct("q_lines")), F.lit(0)).cast("long"))
    df = df.withColumn("q_counts", F.array(*((size - F.size(F.array_remove("q_common", w))).cast("double") for w in LIST)))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    letters = F.greatest(F.col("word_chars") - F.col("q_upper") - F.col("q_digits") - F.col("q_points") - F.col("n_symbols"), F.lit(0))
    white = F.coalesce(F.length("q_text"), F.lit(0)) - F.col("word_chars")
    df = df.withColumn("q_classes", _shares([letters, F.col("q_upper"), F.col("q_points"), F.col("n_symbols"), white]))
    by_language = []
    for words in WORDS.values():
        own = [F.get("q_counts", F.lit(LIST.index(w))) / F.greatest(F.col("n_words"), F.lit(1)) for w in words]
        shares = [v / 100 for v in words.values()]
        by_language.append(divergence(F.array(*own, F.greatest(F.lit(0.0), F.lit(1.0) - sum(own[1:], own[0]))), (*shares, 1 - math.fsum(shares))))
    df = df.withColumns({"class_distance": F.least(*(divergence(F.col("q_classes"), q) for q in CLASSES.values())), "word_distance": F.least(*by_language)})
    long_enough = F.col("word_chars") >= LETTER_GUARD
    enough_words = F.col("n_words") >= WORD_GUARD
    short = F.filter("q_words", lambda w: (F.length(w) <= 4) & w.rlike(r"^\p{L}+$"))
    df = df.withColumn("q_short", F.when(F.col("word_distance") > LACK_LIMIT, F.transform(short, lambda w: F.lower(w))))
    df = df.withColumn("q_again_short", F.size("q_short") - F.size(F.array_distinct("q_short")))
    latin = F.coalesce(F.regexp_count("q_text", F.lit("[A-Za-z]")), F.lit(0)) * 2 > F.col("word_chars")
    lacking = (F.col("word_distance") > LACK_LIMIT) & (F.col("q_again_short") < F.col("n_words") * SHORT_SHARE) & latin
    far = (long_enough & (F.col("class_distance") > CLASS_LIMIT)) | (
        enough_words & (lacking | (F.col("word_distance") > WORD_LIMIT) | ((F.col("class_distance") > BOTH[0]) & (F.col("word_distance") > BOTH[1])))
    )
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, both distances, base_failed and kept: one row for each row of df."""
    rows = _features(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("q_text")))
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
    # all depend on the row number, so that a filter on the result isn't pushed below, where it would repeat them
    return rows.withColumn("q_id", F.monotonically_increasing_id()).select("doc_id", *(F.when(F.col("q_id") >= 0, F.col(c)).alias(c) for c in out))


def filter_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with all their columns."""
    rows = _features(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("q_row"), F.col(text_col).cast("string").alias("q_text")))
    # the row number holds the filter above the projections: pushed below, it would repeat all of their expressions
    return rows.withColumn("q_id", F.monotonically_increasing_id()).where("kept AND q_id >= 0").select("q_row.*")
