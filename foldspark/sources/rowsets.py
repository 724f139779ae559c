"""Categorical row sets over the given tables: ``row_id, group_id, y`` and string levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.functions.hashing import md5_prefix, unit_interval
from foldspark.operators.encoders import dense_counts, with_bucket_counts
from foldspark.session import BROADCAST_ROWS, spread
from foldspark.sources.categories import define_target, normalize

ORDERS_COLUMNS = ["priority", "segment", "nation", "oyear"]
EVENTS_COLUMNS = ["user", "hour"]
DOCS_COLUMNS = ["lang", "source", "size"]
LINE_COLUMNS = ["returnflag", "linestatus", "brand", "ptype"]
EMBEDDING_WIDTH = 64
RUNS = 8
BITS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table that drives row-level work: small files are spread over the cores."""
    return spread(table(spark, sf_dir, name), key)


def orders_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the segment and nation of their customer; customers are the groups."""
    o = fact(spark, sf_dir, "orders", "o_orderkey")
    c = table(spark, sf_dir, "customer")
    c = c if c.count() <= BROADCAST_ROWS else c.hint("merge")  # by rows: Spark would go by the size of the file
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").cast("string").alias("group_id"),
        define_target(F.col("o_orderstatus"), "F").alias("y"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.year("o_orderdate").alias("oyear"),
    )
    return normalize(rows, ORDERS_COLUMNS)


def events_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fact(spark, sf_dir, "events", "event_id")
    return event_rows(e)


def event_rows(e: DataFrame) -> DataFrame:
    rows = e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("group_id"),
        define_target(F.col("event_type"), "purchase").alias("y"),
        F.col("user_id").alias("user"),
        F.hour("ts").alias("hour"),
    )
    return normalize(rows, EVENTS_COLUMNS)


def docs_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; exact copies of a text form a group."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    size = (
        F.when(F.col("n_chars") < 200, "short")
        .when(F.col("n_chars") < 2000, "medium")
        .otherwise("long")
    )
    rows = lab.join(d, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.md5("text").alias("group_id"),
        define_target(F.col("quality"), 1).alias("y"),
        "lang",
        "source",
        size.alias("size"),
    )
    return normalize(rows, DOCS_COLUMNS)


def docs_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as wide binary categories: bit i is set by any word hashed to i."""
    d = fact(spark, sf_dir, "documents", "doc_id")
    words = F.array_distinct(F.split("text", "[ \\t\\n\\r]+"))
    hits = F.array_distinct(F.transform(words, lambda w: F.pmod(md5_prefix(w), F.lit(BITS)).cast("int")))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.md5("text").alias("group_id"),
        define_target(F.col("quality"), 1).alias("y"),
        _bit_levels(hits).alias("levels"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bit_levels(hits: pd.Series) -> pd.Series:
    """Set positions to a dense array of "0" / "1"."""

    def dense(at: np.ndarray) -> np.ndarray:
        out = np.full(BITS, "0", object)
        out[at] = "1"
        return out

    return hits.map(dense)


def docs_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as wide categories: level i is how many of the words hash to i, by two hashes of ``BITS`` values."""
    d = fact(spark, sf_dir, "documents", "doc_id")
    one = lambda h: F.pmod(h, F.lit(BITS)).cast("int")
    two = lambda h: (F.pmod(F.shiftright(h, 20), F.lit(BITS)) + BITS).cast("int")
    # a word is hashed once for both; the hits are sorted later
    both = lambda w: F.get(F.transform(F.array(md5_prefix(w)), lambda h: F.array(one(h), two(h))), F.lit(0))
    at = F.flatten(F.transform(F.split("text", "[ \\t\\n\\r]+"), both))
    rows = table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.md5("text").alias("group_id"),
        define_target(F.col("quality"), 1).alias("y"),
        at.alias("at"),
    )
    counted = with_bucket_counts(rows, F.col("at"))
    dense = dense_counts(F.col("slots"), F.col("counts"), F.lit(2 * BITS))
    return counted.select("row_id", "group_id", "y", F.transform(dense, lambda c: c.cast("int").cast("string")).alias("levels"))


def line_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the brand and type of their part; no row id (aggregates only)."""
    li = fact(spark, sf_dir, "lineitem", "l_orderkey")
    p = table(spark, sf_dir, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("group_id"),
        define_target(F.col("l_returnflag"), "R").alias("y"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("ptype"),
    )
    return normalize(rows, LINE_COLUMNS)


def embedding_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric codes: ``row_id, y, codes ARRAY<DOUBLE>``."""
    e = fact(spark, sf_dir, "embeddings", "vec_id")
    return e.select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") < 5).cast("int").alias("y"),
        F.col("embedding").cast("array<double>").alias("codes"),
    )


def predictions(spark: SparkSession, sf_dir: str, runs: int = RUNS) -> DataFrame:
    """Eight scored runs of every order: run ``r`` mixes noise with the label (run 0 is noise)."""
    rows = orders_cat(spark, sf_dir).select("row_id", "group_id", "segment", "y")
    each = rows.withColumn("run", F.explode(F.array(*[F.lit(r) for r in range(runs)])))
    weight = F.col("run") * F.lit(0.05)
    noise = unit_interval(F.col("run"), F.col("row_id"))
    return each.select(
        F.concat(F.lit("run"), F.col("run").cast("string")).alias("run_id"),
        "run",
        "row_id",
        "group_id",
        "segment",
        F.col("y").alias("y_true"),
        F.round((F.lit(1.0) - weight) * noise + weight * F.col("y"), 3).alias("y_score"),
    )
