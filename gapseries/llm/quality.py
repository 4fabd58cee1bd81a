"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows on which the rules' costs and selectivities are estimated; they settle the order of the rules only, never a verdict.
SAMPLE_ROWS = 2000
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """name, and the condition (over the columns of measured()) on which a text fails."""

    name: str
    fails: Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column, width: int) -> Column:
    """Positions covered by windows of width whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        def start(x: Column, k: Column) -> Column:
            same = (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.when(F.when(k > 0, F.coalesce(same, F.lit(False))).otherwise(F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), x["i"])

        starts = F.sort_array(F.array_compact(F.transform(s, start)))
        zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")), lambda a: a["n"])

    return let(ordered, count)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs as struct _row, with _text (null: empty), _words, _lines and the base counts.

    n_words; word_chars, code points in words; n_symbols, characters of #*$%&|<>; n_dup_lines, lines with a word that equal an
    earlier line; n_repeat_words, words in windows of five words that occur twice or more, the first included.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"))
    bare = F.btrim("_text", F.lit(_SPACE))
    df = df.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != ""))
    n = F.size("_words")
    windows = F.when(n > REPEAT_WINDOW, F.transform(F.sequence(F.lit(1), n - REPEAT_WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, F.lit(REPEAT_WINDOW)))))
    df = df.withColumn("_windows", windows)
    plain = F.col("_text")
    for c in _SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return df.select(
        "_row", "_text", "_words", "_lines",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(plain)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("_windows"), REPEAT_WINDOW)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> list[Rule]:
    """The production rules beyond the base; each fails on what is plainly no prose, so clean documents pass them all."""
    c = F.col
    return [
        Rule("long_or_short_words", (c("word_chars") > 25 * c("n_words")) | (10 * c("word_chars") < 15 * c("n_words"))),
        Rule("symbols", 4 * c("n_symbols") > c("n_words")),
        Rule("repeated_lines", 2 * c("n_dup_lines") > F.size("_lines")),
        Rule("few_letters", 2 * F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")) < c("word_chars")),
        Rule("link_words", 2 * F.size(F.filter("_words", lambda w: w.startswith("http://") | w.startswith("https://"))) > c("n_words")),
    ]


def rule_order(docs: DataFrame, given: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample of about sample_rows, most rejection per cost first; ties keep their order."""
    n = docs.count()
    sample = measured(docs.sample(min(1.0, sample_rows / n), seed=1) if n else docs, text_col).drop("_row").persist()
    rows = max(1, sample.count())
    found = []
    for rule in given:
        began = time.perf_counter()
        failed = sample.agg(F.count(F.when(rule.fails, 1))).first()[0]
        found.append((rule, time.perf_counter() - began, failed / rows))
    sample.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(ordered: list[Rule]) -> Column:
    """True if no rule fails; a rule is looked at only where all before it pass."""
    verdict = None
    for rule in ordered:
        fails = F.coalesce(rule.fails, F.lit(False))
        verdict = F.when(fails, False) if verdict is None else verdict.when(fails, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def assess(docs: DataFrame, text_col: str = "text", given: list[Rule] | None = None) -> DataFrame:
    """docs as _row with the base counts, base_failed and kept. Null or empty texts have no words and fail the base.

    Rows are judged one by one, so repeated rows, ties and any extra columns make no difference; an empty table stays empty.
    """
    order = [r for r, _, _ in rule_order(docs, rules() if given is None else given, text_col)]
    df = measured(docs, text_col).withColumn("base_failed", base_failed())
    return df.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order))).drop("_text", "_words", "_lines")
