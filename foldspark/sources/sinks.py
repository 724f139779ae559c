"""Sinks and their read-back: records, fold tables, predictions, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_SCHEMA = "run_id STRING, row_id BIGINT, y_true TINYINT, y_score DOUBLE"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN has no JSON form: floating columns carry NULL instead."""
    floating = (T.DoubleType, T.FloatType)
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, floating)
    }
    return df.withColumns(fixed) if fixed else df


def append_records(df: DataFrame, root: str, kind: str) -> None:
    """Append records of one kind as JSON lines; fields sorted by name."""
    ordered = nan_to_null(df).select(*sorted(df.columns)).withColumn("kind", F.lit(kind))
    ordered.write.mode("append").partitionBy("kind").option("ignoreNullFields", False).json(root)


def read_records(spark: SparkSession, root: str, kind: str, schema: T.StructType | str) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType(schema.fields + [T.StructField("kind", T.StringType())])
    return spark.read.schema(full).json(root).where(F.col("kind") == kind).drop("kind")


def write_folds(uses: DataFrame, path: str) -> None:
    """Fold table, one directory per outer fold so that a reader of one fold prunes the rest."""
    uses.write.mode("overwrite").partitionBy("outer_fold").parquet(path)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    typed = df.select(
        F.col("run_id").cast("string"),
        F.col("row_id").cast("bigint"),
        F.col("y_true").cast("tinyint"),
        F.col("y_score").cast("double"),
    )
    typed.write.mode("append").partitionBy("run_id").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).parquet(path).select(
        "run_id", "row_id", "y_true", "y_score"
    )


def write_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small report as one ordered CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
