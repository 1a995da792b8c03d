"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: a line fails by punctuation (no closing mark, or mostly marks), as navigation (a row
of short entries between bars) or as boilerplate (fixed phrases). Failed lines are removed, and a document that loses
too large a share of its words is rejected, as is one that fails the base rules on the whole text.

A row is judged within itself, by array functions, so the plan has no shuffle and no Python; a hot source is no
matter. Null and empty texts have no lines and no words and fail the base rule on length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE_CLASS, WORD_CLASS, let, words

SYMBOLS = "[#*$%&|<>]"
#: A line ends well if its last non-space characters are one closing mark, quotes and brackets aside.
CLOSED = "[.!?:;…。！？][\"'\\)\\]»”’]*[\\x20\\x09-\\x0D]*$"
#: Repeated marks such as "!!" or "***" within a line; one of these for every FOUR words is too many.
RUNS = "[!?#*$%&<>=~^]{2,}"
BAR = "[|»›•]"
BOILERPLATE = (
    "(?i)licensed under|all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies"
    "|enable javascript|click here|sign up for our|subscribe to our|©|copyright \\(c\\)|spdx-license-identifier"
)


def _n(pattern: str, line: Column) -> Column:
    return F.size(F.split(line, pattern)) - 1


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether a non-blank line fails a rule; n_words is its number of words."""
    punctuation = ~line.rlike(CLOSED) | (_n(RUNS, line) * 4 >= n_words)
    navigation = (_n(BAR, line) >= 2) & (_n(BAR, line) * 3 >= n_words)
    return punctuation | navigation | line.rlike(BOILERPLATE)


def repeated_window_words(ws: Column, width: int = 5) -> Column:
    """How many words lie in windows of `width` words that occur twice or more among the words ws."""

    def covered(win: Column) -> Column:
        marked = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

        spans = let(let(marked, starts), lambda at: F.transform(at, lambda x, k: F.coalesce(F.least(F.get(at, k + 1) - x, F.lit(width)), F.lit(width))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    found = let(hashes, lambda h: F.when(F.size(h) >= width, let(windows(h), lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(covered(win)))).otherwise(F.lit(0)))
    return found.cast("long")


def clean(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """df with the counts, the cleaned text and the verdict appended (columns of these names are replaced).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long, on the whole text; base_failed: fewer than 10
    words, or over a fifth of them in repeated windows; n_lines: non-blank lines; n_failed_lines; lost_words: words in
    failed lines; clean_text: the lines that passed, blank ones included; kept: not base_failed, and at most max_lost
    of the words lost.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "lost_words", "clean_text", "kept")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ws = words(body)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_window_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, lambda x: x.rlike(WORD_CLASS))
        judged = F.transform(lines, lambda x: let(_words_in(x), lambda n: F.struct(x.alias("line"), n.alias("n"), F.when(n > 0, line_fails(x, n)).otherwise(F.lit(False)).alias("bad"))))

        def sums(j: Column) -> Column:
            bad = F.filter(j, lambda x: x["bad"])
            return F.struct(
                F.size(bad).cast("long").alias("n_failed_lines"),
                F.aggregate(bad, F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("lost_words"),
                F.array_join(F.transform(F.filter(j, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
            )

        return F.struct(
            let(full, lambda f: F.struct(F.size(f).cast("long").alias("n_lines"), (F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"))).alias("l"),
            let(judged, sums).alias("s"),
        )

    kept_columns = [c for c in df.columns if c not in added]
    parts = df.select(
        *(F.col(f"`{c}`") for c in kept_columns),
        let(ws, of_words).alias("__w"),
        (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("__symbols"),
        let(F.split(body, "\n"), of_lines).alias("__l"),
    )
    failed = (F.col("__w.n_words") < 10) | (100 * F.col("__w.n_repeat_words") > 20 * F.col("__w.n_words"))
    return parts.select(
        *(F.col(f"`{c}`") for c in kept_columns),
        "__w.n_words",
        "__w.word_chars",
        F.col("__symbols").alias("n_symbols"),
        F.col("__l.l.n_dup_lines").alias("n_dup_lines"),
        "__w.n_repeat_words",
        failed.alias("base_failed"),
        F.col("__l.l.n_lines").alias("n_lines"),
        F.col("__l.s.n_failed_lines").alias("n_failed_lines"),
        F.col("__l.s.lost_words").alias("lost_words"),
        F.col("__l.s.clean_text").alias("clean_text"),
        (~failed & (F.col("__l.s.lost_words") <= F.lit(max_lost) * F.col("__w.n_words"))).alias("kept"),
    )


def _words_in(line: Column) -> Column:
    return F.size(F.filter(F.split(line, SPACE_CLASS + "+"), lambda w: w != ""))
