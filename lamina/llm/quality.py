"""Line-first quality rules with built-in functions: lines are judged and removed, then documents that lose too much text.

Every row is worked on alone, so nothing is shuffled and a document's length is the only bound on a row's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import SPACE
from lamina.llm.native import covered, paired, placed, repeated_places, words

# The base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WORDS = 20, 30, 8

#: The share of a document's characters, white space apart, that its good lines must keep.
MIN_KEPT = 0.5
#: A line fails with more symbols than this share of its characters, with so many bars or arrows as a menu has, or in capitals of at least so many letters.
MAX_SYMBOL_SHARE, MENU_MARKS, SHOUT_LETTERS = 0.1, 3, 8
#: Lines that sites put on every page.
BOILERPLATE = (
    r"(?i)^[\s\W]*(?:licensed under|all rights reserved|copyright|©|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept (?:all )?cookies"
    r"|sign in|log in|subscribe|share this|read more|click here|skip to content|back to top)\b"
)


def _len(text: Column) -> Column:
    return F.length(text).cast("bigint")


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))


def line_passes(line: Column) -> Column:
    """Whether a line with a word passes the punctuation, navigation and boilerplate rules."""
    punctuation = _symbols(line) <= F.length(line) * MAX_SYMBOL_SHARE
    # Possessive repeats, so that no line is gone over again and again.
    navigation = ~line.rlike(r"(?:[|»›>•·][^|»›>•·]*+){%d}" % MENU_MARKS)
    shouting = F.when(line.rlike(r"\p{Ll}"), F.lit(True)).otherwise(~line.rlike(r"(?:\p{Lu}[^\p{Lu}]*+){%d}" % SHOUT_LETTERS))
    return punctuation & navigation & shouting & ~line.rlike(BOILERPLATE)


def quality(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_kept: float = MIN_KEPT) -> DataFrame:
    """Counts of the base rules, the cleaned text and the verdict for every whole text.

    Returns the columns named in keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), base_failed, clean_text (the good
    lines, of equal ones the first, joined by newlines), kept_share double (characters of good lines over all, white space apart) and kept boolean. A null or
    empty text has no words, fails the base rules and isn't kept. Repeated rows give repeated results; other columns of df don't matter."""
    t = F.col("__t")
    text = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    split = text.select(*keep, "__t", words(t).alias("__w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("__lines"))
    # Hashes of runs of 1, 2, 4 and 8 words; each select reads the one before twice, so none is computed again.
    h = split.select(*keep, "__t", "__lines", F.size("__w").cast("bigint").alias("n_words"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h1"))
    for k in (1, 2, 4):
        h = h.select(*keep, "__t", "__lines", "n_words", paired(F.col(f"__h{k}"), k).alias(f"__h{2 * k}"))
    # Only texts that repeat a window are sorted.
    repeats = F.size(F.array_distinct("__h8")) < F.size("__h8")
    h = h.select(*keep, "__t", "__lines", "n_words", F.when(repeats, placed(F.col("__h8"))).alias("__at"))
    h = h.select(*keep, "__t", "__lines", "n_words", F.when(F.col("__at").isNotNull(), repeated_places(F.col("__at"))).alias("__at"))
    counted = h.select(
        *keep, "__t", "n_words", _len(F.regexp_replace(t, f"[{SPACE}]+", "")).alias("word_chars"), _symbols(t).cast("bigint").alias("n_symbols"),
        F.array_distinct("__lines").alias("__lines"), F.size("__lines").alias("__n"),
        F.when(F.col("__at").isNotNull(), covered(F.col("__at"), REPEAT_WORDS)).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    cleaned = counted.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.col("__n") - F.size("__lines")).cast("bigint").alias("n_dup_lines"), "n_repeat_words",
        failed.alias("base_failed"), F.array_join(F.filter("__lines", line_passes), "\n").alias("clean_text"),
    )
    share = F.when(F.col("word_chars") > 0, _len(F.regexp_replace("clean_text", f"[{SPACE}]+", "")) / F.col("word_chars")).otherwise(F.lit(0.0))
    measured = cleaned.withColumn("kept_share", share)
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept))
