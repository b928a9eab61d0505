"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by itself: lines of symbols or without punctuation, navigation and boilerplate are taken out, and a document that
loses too much of its text with them is rejected. A few whole-document counts come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rectpart.llm.textops import SPACE_CLASS, WORD_CLASS

SYMBOL_CLASS = "[#*$%&|<>]"
#: A line of at least so many words that ends without punctuation is still prose.
LONG_LINE = 12
#: A line with a separator (| » > • ·) for so few characters is a row of a menu or table; one with a symbol for so few is junk.
SEPARATOR_CLASS, CHARS_PER_SEPARATOR, CHARS_PER_SYMBOL = "[|\\u00BB>\\u2022\\u00B7]", 30, 12
#: Phrases of boilerplate lines, compared in lower case; a free choice.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript",
    "powered by", "click here", "subscribe to our", "sign up for our", "lorem ipsum", "copyright (c)",
)
#: A phrase counts where no letter or digit stands before or behind it. A line with one for so few characters is boilerplate; a longer line is prose that mentions it.
CHARS_PER_PHRASE = 100
PHRASE = "(?<![\\p{L}\\p{N}_])(?:" + "|".join(p.replace("(", "\\(").replace(")", "\\)") for p in BOILERPLATE) + ")(?![\\p{L}\\p{N}_])"
#: A document goes if less than this share of its word characters is left.
LEAST_LEFT = 0.5
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30


def count_of(text: Column, char_class: str) -> Column:
    return F.regexp_count(text, F.lit(char_class))


def word_list(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that isn't null."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def with_repeated_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many of a text's words lie in a window of WINDOW words that occurs twice or more.

    Windows are first compared by hash; only a text in which two hashes agree is examined by the windows themselves. What several expressions use is a
    column of its own, so that it's evaluated once a row.
    """
    last = F.size(words) - WINDOW
    around = lambda array, i: [F.get(array, i + k) for k in range(WINDOW)]  # noqa: E731  slice() would copy the whole array each time
    step = docs.withColumn(f"{out}_h", F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn(f"{out}_w", F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*around(f"{out}_h", i)))))
    some = (last >= 1) & (F.size(F.array_distinct(f"{out}_w")) < F.size(f"{out}_w"))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", *around(words, i)).alias("w"), i.alias("i"))))
    # a window is a repeat if a neighbour in the sorted order is the same
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    twice = F.get(F.transform(F.array(windows), lambda ws: F.filter(ws, lambda x, i: same(F.get(ws, i - 1), x) | same(F.get(ws, i + 1), x))), F.lit(0))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return step.withColumn(out, F.when(some, covered).otherwise(F.lit(0))).drop(f"{out}_h", f"{out}_w")


def is_prose(line: Column) -> Column:
    """Whether a line with a word stays: no or little boilerplate, few separators and symbols for its length, and punctuation at its end or many words. Cheap tests come first."""
    # the line in lower case is the variable of a lambda, so that it's made once
    clean = F.get(F.transform(F.array(F.lower(line)), lambda low: ~reduce(lambda some, phrase: some | low.contains(phrase), BOILERPLATE, F.lit(False)) | (count_of(low, PHRASE) * CHARS_PER_PHRASE < F.length(line))), F.lit(0))
    few = (count_of(line, SEPARATOR_CLASS) * CHARS_PER_SEPARATOR < F.length(line)) & (count_of(line, SYMBOL_CLASS) * CHARS_PER_SYMBOL < F.length(line))
    ends = F.right(line, F.lit(8)).rlike("[.!?:;…。][\\s\"')\\]”»]*$")
    return clean & few & (ends | (F.size(word_list(line)) >= LONG_LINE))


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns and _q, a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, left_chars and clean (the text of the lines that stay).

    Null text counts as empty; texts without a word fail. Repeated rows are judged alike, an empty table gives no rows, other columns pass through as they are. No shuffle.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    words = word_list(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CLASS))
    step = docs.withColumns({"_q_words": words, "_q_lines": lines, "_q_chars": F.length(text) - count_of(text, SPACE_CLASS), "_q_symbols": count_of(text, SYMBOL_CLASS)})
    prose = F.filter("_q_lines", is_prose)
    step = with_repeated_words(step, "_q_words", "_q_repeat").withColumn("_q_prose", prose)
    step = step.withColumn("_q_left", F.aggregate("_q_prose", F.lit(0), lambda n, x: n + F.length(x) - count_of(x, SPACE_CLASS)))
    n = F.size("_q_words")
    failed = (n < LEAST_WORDS) | (F.col("_q_repeat") * 100 > n * MOST_REPEATED)
    result = F.struct(
        n.cast("long").alias("n_words"), F.col("_q_chars").cast("long").alias("word_chars"), F.col("_q_symbols").cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"), F.col("_q_repeat").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (F.col("_q_left") >= F.col("_q_chars") * LEAST_LEFT)).alias("kept"), F.col("_q_left").cast("long").alias("left_chars"), F.array_join("_q_prose", "\n").alias("clean"),
    )
    # one array element: a filter on the result then isn't pushed below the steps, where each would be evaluated within the next
    return step.withColumn("_q", F.explode(F.array(result))).drop("_q_words", "_q_lines", "_q_chars", "_q_symbols", "_q_repeat", "_q_prose", "_q_left")
