"""Benchmark decontamination by winnowed fingerprints.

A text keeps the minimum of every ``span - gram + 1`` consecutive hashes of ``gram`` words. A shared
span of ``span`` words holds one whole such window, hence its minimum, so documents and items that
share a span share a fingerprint. Fingerprints find the candidate documents; their hits are then extended
to all shared windows by comparing the words themselves. Items of fewer words than ``span`` are one
window: hashes of every run of their length (winnowing with a window of one) find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.tables import attach, bounded, join_documents, settle, with_key
from foldspark.llm.text import NOT_ALNUM, ascii_lower, bind, pieces, span_hashes

WINDOW_ROWS = 200_000  # windows of about 100 bytes: at most about 20 MB are broadcast


def _with_words(rows: DataFrame) -> DataFrame:
    lowered = rows.withColumn("text", ascii_lower(F.coalesce("text", F.lit(""))))
    return lowered.withColumn("ws", pieces(F.col("text"), NOT_ALNUM)).drop("text").withColumn("n", F.size("ws"))


def _run(start: Column, length: int | Column) -> Column:
    return F.concat_ws(" ", F.slice("ws", start + 1, length))


def _starts(length: int) -> Column:
    return F.when(F.col("n") >= length, F.sequence(F.lit(0), F.col("n") - length)).otherwise(F.array().cast("array<int>"))


def _with_winnowed(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """Add ``prints``: the distinct window minima of texts of at least ``span`` words."""
    width = span - gram + 1

    def minima(grams: Column) -> Column:
        return F.transform(_starts(span), lambda i: F.array_min(F.slice(grams, i + 1, width)))

    return rows.withColumn("prints", F.array_distinct(bind(span_hashes("ws", "n", gram), minima)))


def _runs_of(length: int) -> Column:
    return F.transform(_starts(length), lambda i: F.struct(i.alias("s"), F.lit(length).alias("len")))


def _short_prints(length: int) -> Column:
    return F.transform(_starts(length), lambda i: F.xxhash64(F.lit(length), _run(i, length)))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13, gram: int = 7) -> DataFrame:
    """One row a document: k, doc_id, n_words, n_hit, n_items, item_ids (sorted strings).

    Null texts have no words; items without words have no window; a null item id is called "null".
    Equal items each count. Repeated rows get the same result each. Other columns are ignored.
    """
    items = _with_words(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text"))
    items = settle(items.where("n > 0").dropDuplicates(["item", "ws"]), "bench-items")
    # at most span - 1 values
    short = sorted(r.n for r in items.where(F.col("n") < span).select("n").distinct().collect())

    long_prints = _with_winnowed(items.where(F.col("n") >= span), span, gram).select(F.explode("prints").alias("h"))
    short_prints = items.where(F.col("n") < span).select(F.xxhash64("n", F.concat_ws(" ", "ws")).alias("h"))
    known = bounded(settle(long_prints.unionByName(short_prints).distinct(), "bench-prints"))

    printed = _with_winnowed(_with_words(with_key(docs)), span, gram)
    prints = settle(printed.select("k", "doc_id", "n", F.concat("prints", *map(_short_prints, short)).alias("prints")), "doc-prints")
    found = prints.select("k", "doc_id", F.explode("prints").alias("h")).join(known, "h", "left_semi")
    suspects = settle(found.select("k", "doc_id").distinct(), "suspects")

    in_items = items.select("item", F.least("n", F.lit(span)).alias("len"), "ws", "n")
    starts = F.sequence(F.lit(0), F.col("n") - F.col("len"))
    windows = in_items.select("item", "ws", "len", F.explode(starts).alias("s")).select(
        "item", "len", _run(F.col("s"), F.col("len")).alias("w")
    )
    windows = bounded(settle(windows.distinct(), "bench-windows"), WINDOW_ROWS)
    texts = _with_words(join_documents(with_key(docs), bounded(suspects), "left_semi").distinct())
    runs = texts.select("k", "doc_id", "ws", F.explode(F.concat(*map(_runs_of, [span, *short]))).alias("r"))
    runs = runs.select("k", "doc_id", "r.s", "r.len", _run(F.col("r.s"), F.col("r.len")).alias("w"))
    hits = runs.join(windows, ["len", "w"]).groupBy("k", "doc_id").agg(
        F.collect_set(F.struct("s", "len")).alias("at"), F.array_sort(F.collect_set("item")).alias("item_ids")
    )
    covered = F.transform("at", lambda x: F.sequence(x["s"], x["s"] + x["len"] - 1))
    hits = hits.select("k", "doc_id", F.size(F.array_distinct(F.flatten(covered))).alias("n_hit"), "item_ids")
    rows = join_documents(prints.select("k", "doc_id", F.col("n").cast("bigint").alias("n_words")), hits)
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select(
        "k",
        "doc_id",
        "n_words",
        F.coalesce(F.col("n_hit").cast("bigint"), F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        ids.alias("item_ids"),
    )


def contaminated(percent: int = 5) -> Column:
    """At least ``percent`` of the words are hit."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 13, percent: int = 5) -> DataFrame:
    """``docs`` without contaminated documents, all columns kept."""
    bad = contamination(docs, benchmark, span).where(contaminated(percent)).select("k", "doc_id", F.lit(True).alias("bad"))
    verdict = bounded(settle(bad.distinct(), "contaminated"))
    return attach(docs, verdict).where("bad is null").select("row.*")
