"""Sources of categorical tables, target definition, profile and fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.functions.hashing import length_prefixed, md5_prefix

NULL_LEVEL = "?"  # fixed value: missing entries are an ordinary level


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_headerless(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Delimited text without a header: names are given, every field is a string."""
    return spark.read.schema(_strings(columns)).option("sep", sep).csv(path)


def read_with_header(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Delimited text with a header and an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_gzip_tsv(
    spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None
) -> DataFrame:
    """Gzip is not splittable: spread the rows of each file after reading."""
    df = read_with_header(spark, path, schema, sep="\t")
    columns = [F.col(c) for c in df.columns]
    return df.repartition(partitions, *columns) if partitions else df.repartition(*columns)


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def normalize(df: DataFrame, columns: Sequence[str], null_level: str = NULL_LEVEL) -> DataFrame:
    """Every category as an exact string; NULL becomes an ordinary level."""
    done = {c: F.coalesce(F.col(c).cast("string"), F.lit(null_level)) for c in columns}
    return df.withColumns(done)


def define_target(column: Column, positive) -> Column:
    """1 for the source-defined positive value, else 0; a NULL target is an error."""
    missing = F.raise_error(F.lit("target is NULL")).cast("int")
    return F.when(column.isNull(), missing).otherwise((column == F.lit(positive)).cast("int"))


class Wide(list):
    """Many categories held in one array column; they are named by position, "0", "1", …"""

    def __init__(self, array: str, width: int):
        super().__init__(str(i) for i in range(width))
        self.array = array


def level_array(columns: Sequence[str]) -> Column:
    """All categories of a row as one array, in column order."""
    return F.col(columns.array) if isinstance(columns, Wide) else F.array(*columns)


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, column): ``keep…, col, level``."""
    if isinstance(columns, Wide):
        each = df.select(*keep, F.posexplode(columns.array).alias("col", "level"))
        return each.withColumn("col", F.col("col").cast("string"))
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("level")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.col", "_p.level")


def profile(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """One row per column: rows, distinct levels, and the sorted target levels of the table."""
    levels = (
        to_long(df, columns, [])
        .groupBy("col", "level")
        .agg(F.count("*").alias("n"))
        .groupBy("col")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_levels"), F.max("n").alias("top_count"))
    )
    seen = df.groupBy(target).agg(F.count("*").alias("n"))
    target_levels = seen.agg(
        F.array_join(F.array_sort(F.collect_list(F.col(target).cast("string"))), ",").alias("t")
    ).scalar()
    return levels.withColumns(
        {"target_levels": target_levels, "n_columns": F.lit(len(columns)).cast("bigint")}
    )


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive content hash: row count and exact sum of 48-bit row hashes."""
    row = md5_prefix(length_prefixed(list(columns))).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(row).cast("string").alias("content_hash"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each raw file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
