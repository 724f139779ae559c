"""Session helpers: a local session for tests, shared scratch tables, size checks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A lookup side of at most this many rows and bytes in memory is broadcast; beyond it we shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foldspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="foldspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, label: str = "table", *partition_by: str) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst exact file
    sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/foldspark/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that an iteration has replaced and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None) if "_scratch_path" in vars(table) else None
        if path:
            context = table.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def forget_shuffles(df: DataFrame) -> None:
    """Collect the driver's garbage: Spark deletes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input one partition per core; a scan that already has them is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
