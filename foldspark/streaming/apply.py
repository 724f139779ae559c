"""Apply a fitted state to an unbounded source: a stateless stream-static join, or one per micro-batch against the
version of the state that is current then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldspark.operators.skew import lookup


class VersionedState:
    """Fitted codes below ``path``, one folder a version; a version counts once its folder is complete.

    A state carries its own codes of unseen levels, as records without a level: the prior of a target encoder, 0 of
    a count. ``n``, the rows of a level, tells the hot ones.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def publish(self, states: DataFrame, unseen: DataFrame) -> int:
        """Write ``states`` (col, level, n, code) and ``unseen`` (col, code) as the next version."""
        version = (self.current() or 0) + 1
        rest = unseen.select("col", F.lit(None).cast("string").alias("level"), F.lit(0).cast("bigint").alias("n"), F.col("code").cast("double").alias("code"))
        every = states.select("col", "level", F.col("n").cast("bigint").alias("n"), F.col("code").cast("double").alias("code")).unionByName(rest)
        every.write.parquet(f"{self.path}/version={version}")
        return version

    def current(self) -> int | None:
        """The newest complete version."""
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(root):
            return None
        done = [f.getPath() for f in files.listStatus(root) if files.exists(context._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max((int(d.getName().split("=")[1]) for d in done), default=None)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("col STRING, level STRING, n BIGINT, code DOUBLE").parquet(f"{self.path}/version={version}")

    def encode(self, rows: DataFrame, columns: list[str], version: int) -> DataFrame:
        """``rows`` with ``codes`` in column order and the ``version`` they come from."""
        states = self.read(version)
        unseen = {r.col: r.code for r in states.where("level IS NULL").collect()}  # one record a column
        out = rows
        for i, c in enumerate(columns):
            one = states.where((F.col("col") == c) & F.col("level").isNotNull())
            out = lookup(out, one.select(F.col("level").alias(c), "n", F.col("code").alias(f"_c{i}")), [c], [x for x in rows.columns if x != c][:1])
        codes = F.array(*[F.coalesce(F.col(f"_c{i}"), F.lit(unseen[c])) for i, c in enumerate(columns)])
        return out.withColumns({"codes": codes, "version": F.lit(version)}).drop(*[f"_c{i}" for i in range(len(columns))])


def encode_versions(
    stream: DataFrame, state: VersionedState, columns: list[str], sink: str, progress: str, keep: list[str]
) -> StreamingQuery:
    """Code every micro-batch with the version that is current when it starts; ``keep`` columns, codes and version are
    written below ``sink``, one folder a batch, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, batch_id: int) -> None:
        coded = state.encode(batch, columns, state.current()).select(*keep, "codes", "version")
        coded.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", progress).trigger(availableNow=True).start()


def encode_stream(stream: DataFrame, states: DataFrame, columns: list[str], unseen: float) -> DataFrame:
    """Left-join every category of the stream to its fitted ``code``; append mode, no state.

    ``states`` is a fitted table ``(col, level, code)``. Its size decides per micro-batch how
    the join is run, because the static side is read from files of known size.
    """
    out = stream
    for i, c in enumerate(columns):
        one = states.where(F.col("col") == c).select(F.col("level").alias(c), F.col("code").alias(f"_c{i}"))
        out = out.join(one, c, "left")
    codes = F.array(*[F.coalesce(F.col(f"_c{i}"), F.lit(unseen)) for i in range(len(columns))])
    return out.withColumn("codes", codes).drop(*[f"_c{i}" for i in range(len(columns))])
