"""Words, lines and their statistics as column expressions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
REPEAT_SPAN = 5


def pieces(text: Column, breaks: str) -> Column:
    """Maximal runs of characters other than ``breaks``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), breaks), "")


def words(text: Column) -> Column:
    return pieces(text, SPACES)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the faster function, which is equal there."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(
        F.lower(text)
    )


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside a lambda
    (the optimizer would move its expression into the lambda and compute it for every entry)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span_hashes(items: str, size: str, span: int) -> Column:
    """64-bit hashes of every ``span`` consecutive entries of the array ``items`` of ``size`` entries."""

    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(items), i + j) for j in range(span)])

    none = F.array().cast("array<bigint>")
    return F.when(F.col(size) >= span, F.transform(F.sequence(F.lit(0), F.col(size) - span), one)).otherwise(none)


def with_word_stats(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of column ``text``.

    Words of 5-word windows found twice or more in the text are repeats; windows are compared by
    64-bit hashes within one text. ``ws`` (the words) stays in the table for further statistics.
    """
    line = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    free = F.coalesce("text", F.lit(""))
    out = docs.withColumns({"ws": words(F.col("text")), "_lines": line})
    out = out.withColumns(
        {
            "n_words": F.size("ws").cast("bigint"),
            "word_chars": F.length(F.regexp_replace(free, SPACES, "")).cast("bigint"),
            "n_symbols": F.regexp_count(free, F.lit(SYMBOLS)).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_n": F.size("ws"),
        }
    ).drop("_lines")
    out = out.withColumn("_h", span_hashes("ws", "_n", REPEAT_SPAN)).drop("_n")
    out = out.withColumn("_h", F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))

    def repeated(x: Column, i: Column) -> Column:
        same = (F.get(F.col("_h"), i - 1)["h"] == x["h"]) | (F.get(F.col("_h"), i + 1)["h"] == x["h"])
        return F.when(same, x["p"])

    found = F.filter(F.transform("_h", repeated), lambda p: p.isNotNull())
    out = out.withColumn("_h", F.sort_array(found))
    step = F.transform(
        "_h", lambda p, i: F.least(F.coalesce(F.get(F.col("_h"), i + 1) - p, F.lit(REPEAT_SPAN)), F.lit(REPEAT_SPAN))
    )
    covered = F.aggregate(step, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.withColumn("n_repeat_words", covered).drop("_h")
