"""Information lost by an encoding: conditional risks on raw categories and on codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_DIGITS = 12  # fixed value: codes equal to 12 digits are one fiber


def joint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Empirical joint: one cell per distinct tuple with ``n`` and ``pos``.

    Every encoding is a function of the tuple, so the rows are read once and all further work
    is on distinct tuples.
    """
    return rows.groupBy(*columns).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def _entropy(eta: Column) -> Column:
    """Binary entropy in nats; 0 at 0 and 1."""
    inner = -(eta * F.log(eta) + (1 - eta) * F.log(1 - eta))
    return F.when((eta > 0) & (eta < 1), inner).otherwise(0.0)


def risk(cells: DataFrame, fiber: list[str], keys: list[str]) -> DataFrame:
    """H(Y|fiber) in nats and E[eta(1-eta)] per key; ``n_cells`` counts the reachable codes."""
    per = cells.groupBy(*keys, *fiber).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    eta = F.col("pos") / F.col("n")
    sums = per.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * _entropy(eta)).alias("_h"),
        F.sum(F.col("n") * eta * (1 - eta)).alias("_b"),
        F.count("*").alias("n_cells"),
    )
    return sums.select(
        *keys,
        (F.col("_h") / F.col("_n")).alias("logloss_risk"),
        (F.col("_b") / F.col("_n")).alias("brier_risk"),
        "n_cells",
    )


def gap(cells: DataFrame, columns: list[str], code: str, keys: list[str]) -> DataFrame:
    """I(Y;X|Z) and E[Var(eta|Z)] of the encoding in column ``code`` (an array), per key.

    ``cells`` holds every distinct tuple with its code under every key. Both are zero exactly
    when the posterior is constant inside each fiber.
    """
    fiber = cells.withColumn("_z", F.transform(code, lambda v: F.round(v, CODE_DIGITS)))
    raw = risk(cells, columns, keys)
    coded = risk(fiber, ["_z"], keys)
    raw = raw.withColumnsRenamed({"logloss_risk": "_rl", "brier_risk": "_rb", "n_cells": "n_raw"})
    return raw.join(coded, keys).select(
        *keys,
        (F.col("logloss_risk") - F.col("_rl")).alias("logloss_gap"),
        (F.col("brier_risk") - F.col("_rb")).alias("brier_gap"),
        "n_raw",
        F.col("n_cells").alias("n_codes"),
    )
