"""The table of a run: predictions of all cells, appended once, and commit records that make them count.

A cell writes its predictions below an attempt of its own and is then committed by one record that names the attempt. What
an interrupted attempt left is never read, nothing is overwritten, and a restart runs only the cells without a
record. All cells are evaluated from one read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.session import scratch_dir

RUN_SCHEMA = (
    "run_id STRING, config STRING, outer_fold INT, encoder STRING, layout STRING, model STRING, seed INT, protocol STRING, "
    "status STRING, stage_of_failure STRING, exception_class STRING, inner_status STRING, inner_elapsed_s DOUBLE"
)
PREDICTION_SCHEMA = "row_id BIGINT, y_true INT, y_score DOUBLE"
NAMES = [c.split()[0] for c in RUN_SCHEMA.split(", ")]


class RunTable:
    """Predictions and records below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, carry: str = "") -> None:
        """``carry`` is the schema of further columns of the rows that predictions keep, such as those to report by."""
        self.spark = spark
        self.schema = f"{PREDICTION_SCHEMA}, {carry}" if carry else PREDICTION_SCHEMA
        self.carry = [c.split()[0] for c in carry.split(", ") if c]
        self.path = path or f"{scratch_dir(spark)}/foldspark/runs-{uuid.uuid4().hex}"

    def attempt(self) -> str:
        return uuid.uuid4().hex

    def write(self, scored: DataFrame, attempt: str, phase: str) -> DataFrame:
        """Append the predictions ``row_id, y_true, y_score, carry…`` of one phase; returns them as written."""
        where = f"{self.path}/predictions/attempt={attempt}/phase={phase}"
        scored.write.parquet(where)
        return self.spark.read.schema(scored.schema).parquet(where)

    def commit(self, record: dict, attempt: str) -> None:
        """One record: from here on the cell is finished, whatever its status."""
        one = self.spark.createDataFrame([tuple(record[n] for n in NAMES)], RUN_SCHEMA).coalesce(1)
        one.write.parquet(f"{self.path}/commits/attempt={attempt}")  # of its own: cells commit side by side

    def _exists(self, name: str) -> bool:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)

    def commits(self) -> DataFrame:
        """The first record of every cell with its attempt; one row a cell."""
        schema = f"{RUN_SCHEMA}, attempt STRING"
        if not self._exists("commits"):
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.schema(schema).parquet(f"{self.path}/commits")
        first = every.groupBy("run_id").agg(F.min_by(F.struct(*every.columns), "attempt").alias("r"))
        return first.select("r.*")

    def finished(self) -> set[str]:
        return {r.run_id for r in self.commits().select("run_id").collect()}  # one name a cell of the grid

    def runs(self) -> DataFrame:
        return self.commits().drop("attempt")

    def predictions(self) -> DataFrame:
        """``run_id, phase, row_id, y_true, y_score, carry…`` of all committed cells, in one read."""
        named = F.broadcast(self.commits().select("attempt", "run_id"))  # one row a cell
        if not self._exists("predictions"):
            return self.spark.createDataFrame([], f"run_id STRING, phase STRING, {self.schema}")
        read = self.spark.read.schema(f"{self.schema}, attempt STRING, phase STRING").parquet(f"{self.path}/predictions")
        return read.join(named, "attempt").select("run_id", "phase", "row_id", "y_true", "y_score", *self.carry)
