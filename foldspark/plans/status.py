"""Typed run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The status vocabulary
SUCCESS = "SUCCESS"
SKIPPED = "SKIPPED_INELIGIBLE"
STATUSES = (
    "SUCCESS",
    "SKIPPED_INELIGIBLE",
    "PREPROCESSING_FAILURE",
    "ENCODING_FAILURE",
    "LAYOUT_FAILURE",
    "IMAGE_RENDER_FAILURE",
    "TRAINING_FAILURE",
    "RESOURCE_LIMIT",
    "TIMEOUT",
    "NUMERICAL_FAILURE",
    "METRIC_UNDEFINED",
    "INTERRUPTED",
    "UNKNOWN_FAILURE",
    "DEPENDENCY_UNAVAILABLE",
    "MODEL_ACCESS_NOT_AUTHORIZED",
)
FAILURES = tuple(s for s in STATUSES if s not in (SUCCESS, SKIPPED))
# absolute paths and addresses: a drive or scheme may stand before the slashes
PATH_PATTERN = r"""(^|[\s'"(=,])(?:[A-Za-z][\w+.-]*:)?[/\\]+[^\s'"]+"""
MESSAGE_LIMIT = 300


def known_status(status: Column) -> Column:
    """The status itself, or an error for a word outside the vocabulary."""
    wrong = F.raise_error(F.concat(F.lit("unknown status "), status)).cast("string")
    return F.when(status.isin(*STATUSES), status).otherwise(wrong)


def gate(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Only SUCCESS records carry metrics."""
    ok = known_status(F.col("status")) == SUCCESS
    gated = {m: F.when(ok, F.col(m)) for m in metrics}
    failed = F.col("status").isin(*FAILURES)
    return df.withColumns(gated).withColumn("is_failure", failed)


def is_finite(value: Column) -> Column:
    inf = F.lit(float("inf"))
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < inf)


def nonfinite_guard(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Count rows whose numeric array holds NaN, infinity or NULL; such a run failed."""
    bad = F.exists(values, lambda v: ~is_finite(v))
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_nonfinite"))
        .withColumn("status", F.when(F.col("n_nonfinite") > 0, "NUMERICAL_FAILURE").otherwise(SUCCESS))
    )


def sanitize(message: Column) -> Column:
    """Replace file paths and keep at most 300 characters."""
    return F.left(F.regexp_replace(message, PATH_PATTERN, "$1<path>"), F.lit(MESSAGE_LIMIT))
