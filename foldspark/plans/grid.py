"""Experiment grids as tables: one record per cell, ineligible ones marked before any work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.layouts import MAX_PIXELS, native_pixels
from foldspark.session import materialize

PLAN = ("branch", "encoder", "layout", "model", "seed")
ONEHOT_CAP = 1500


def code_widths(states: DataFrame, columns: list[str]) -> DataFrame:
    """``outer_fold, encoder, width`` from the levels fitted on each inner-training side."""
    from foldspark.operators.encoders import bucket_width

    total = states.where("phase = 'inner'").groupBy("outer_fold").agg(F.count("*").alias("k"))
    m = len(columns)
    buckets = bucket_width(F.col("k"), m)
    width = {
        "label": F.lit(m), "target": F.lit(m), "onehot": F.col("k") + m, "hash_column": buckets, "hash_shared": buckets,
    }
    each = [F.struct(F.lit(e).alias("encoder"), w.cast("bigint").alias("width")) for e, w in width.items()]
    return total.select("outer_fold", F.explode(F.array(*each)).alias("e")).select("outer_fold", "e.*")


def expand(widths: DataFrame, runs: list[tuple], onehot_cap: int = ONEHOT_CAP, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One record for every planned run in every fold of every data set.

    ``widths`` holds dataset_id, outer_fold, encoder, width; ``runs`` is the caller's plan, tuples of ``PLAN``.
    Layout "none" marks tabular runs; an encoder without a width (such as "raw") is never too wide.
    """
    widths = materialize(widths, "widths")
    plan = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(PLAN, run, strict=True)]) for run in runs])
    folds = widths.select("dataset_id", "outer_fold").distinct()
    cells = folds.withColumn("run", F.explode(plan)).select("dataset_id", "outer_fold", "run.*")
    cells = cells.join(widths, ["dataset_id", "outer_fold", "encoder"], "left")
    too_wide = (F.col("encoder") == "onehot") & (F.col("width") > onehot_cap)
    too_large = (F.col("layout") != "none") & (native_pixels(F.col("layout"), F.col("width")) > max_pixels)
    rule = F.when(too_wide, "onehot_width_cap").when(too_large, "pixel_cap").otherwise("none")
    names = ["dataset_id", "outer_fold", *PLAN]
    return cells.select(
        F.concat_ws("/", *names).alias("cell_id"),
        *names,
        rule.alias("eligibility_rule"),
        F.when(rule == "none", "PENDING").otherwise("SKIPPED_INELIGIBLE").alias("status"),
    )
