"""Quality rules: a threshold table compiled into one projection, with no user functions.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this by at or from an a not have "
    "der die das und ist von zu mit den ein eine nicht auf im sich des dem "
    "le la les de et des en un une du que qui pour dans par sur au est "
    "el los las y del por con para una como su al es lo se"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if the figure lies below ``low`` or above ``high``; None sets no bound."""

    name: str
    figure: str
    low: float | None = None
    high: float | None = None


#: The table that the query uses. Figures are SQL expressions over the columns of :func:`measure`.
RULES = (
    Rule("length", "n_words", 50, 1_000_000),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2.0, 14.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", None, 0.1),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.3),
    Rule("repetition", "n_repeat_words / greatest(n_words, 1)", None, 0.5),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add :data:`MEASURES` (all long). Columns of ``df`` of these names give way to the new ones; all others stay.

    A null text has no words, like an empty one; texts are measured whole, however long. Rows are measured one by one,
    so repeated rows give repeated results and an empty table an empty one.

    Each array is a column of its own projection because a lambda evaluates what it refers to once for each
    element; as a column it is made once for a row. Nothing is exploded, so there is no shuffle.
    """
    df, own, back = common.apart(df, *MEASURES, t=F.coalesce(common.column(text), F.lit("")))
    df = df.withColumn("words", F.filter(F.split("t", SPACE + "+"), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("hash", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.select(
        *own,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        "hash",
    )
    df = _with_repeats(df)
    return df.select(*back, *MEASURES)


def _with_repeats(df: DataFrame) -> DataFrame:
    """Replace the word hashes by n_repeat_words, the words in three-word windows that occur twice.

    The windows' hashes are sorted with their places; a window repeats if a neighbour has its hash. The result is
    the length of the union of what such windows cover. Hashes have 64 bits and meet only within one text.
    """
    keep = [c for c in df.columns if c != "hash"]
    starts = F.when(F.size("hash") >= 3, F.sequence(F.lit(0), F.size("hash") - 3)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get("hash", i), F.get("hash", i + 1), F.get("hash", i + 2)).alias("h"), i.alias("i"))

    def repeats(x: Column, j: Column) -> Column:
        return F.coalesce(F.get("w", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("w", j + 1)["h"] == x["h"], F.lit(False))

    def cover(so_far: Column, at: Column) -> Column:
        return F.struct((at + 3).alias("end"), (so_far["n"] + at + 3 - F.greatest(so_far["end"], at)).alias("n"))

    df = df.select(*keep, F.sort_array(F.transform(starts, window)).alias("w"))
    df = df.select(*keep, F.sort_array(F.transform(F.filter("w", repeats), lambda x: x["i"])).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover)
    return df.select(*keep, covered["n"].cast("long").alias("n_repeat_words"))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:func:`measure`, base_failed (under 50 words, or over half of the words repeat) and kept (no rule is broken).
    Nulls, long texts, repeated rows, empty tables and clashing names are as there; base_failed and kept are new too."""
    df = measure(df.select(*(common.column(c) for c in common.others(df, "base_failed", "kept"))), text).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One condition for the whole table."""
    passed = F.lit(True)
    for rule in rules:
        figure = F.expr(rule.figure)
        if rule.low is not None:
            passed &= figure >= F.lit(rule.low)
        if rule.high is not None:
            passed &= figure <= F.lit(rule.high)
    return passed
