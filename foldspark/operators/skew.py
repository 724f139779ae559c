"""Lookup joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.session import BROADCAST_BYTES, BROADCAST_ROWS

HOT_SHARE = 0.001  # a key above this share of the rows is hot: at most 1,000 such keys
SALTS = 64


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str],
    weight: str = "n",
    how: str = "left",
    rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key and a row ``weight`` per key.

    ``right`` must be a materialized table: its row count (``rows`` if known, else read from
    the file footers) and its size in memory decide. Small tables are broadcast. Otherwise both sides are shuffled on (key, salt), where only hot keys are
    salted; the hot keys number at most ``1 / HOT_SHARE`` by construction, so their list
    is broadcast. ``spread`` names left columns that distinguish the rows of one key.
    """
    if (right.count() if rows is None else rows) <= BROADCAST_ROWS and memory_size(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop(weight)), on, how)
    return salted_lookup(left, right, on, spread, weight, how)


def memory_size(table: DataFrame) -> int:
    """About the bytes of all rows in memory; files are many times smaller where values repeat."""
    return table.agg(F.sum(sum((_bytes(F.col(f.name), f.dataType) for f in table.schema), F.lit(16)))).first()[0] or 0


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) * _width(kind.elementType) + 24
    return F.lit(_width(kind))


def _width(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return 16 + sum(_width(f.dataType) for f in kind)
    return 8 if isinstance(kind, T.NumericType) else 24


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str],
    weight: str = "n",
    how: str = "left",
    hot_share: float = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    total = right.agg((F.sum(weight) * F.lit(hot_share)).alias("cut")).scalar()
    marked = right.withColumn("_hot", F.col(weight) > total)
    hot = marked.where("_hot").select(*on, F.lit(True).alias("_is_hot"))
    salted_left = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0),
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    # the hint keeps Spark from a broadcast by file size: repeated values take little room in files, but not in memory
    salted_right = marked.withColumn("_salt", F.explode(copies)).drop("_hot", weight).hint("merge")
    return salted_left.join(salted_right, on + ["_salt"], how).drop("_salt", "_is_hot")
