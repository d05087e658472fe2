"""Session helpers: table loading and scratch storage that every executor shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column of :func:`dealt`, and rows that one of its tasks takes at most and at least, about.
PART, MOST_ROWS, LEAST_ROWS = "_part", 250_000, 20_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set at ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the session names one.

    Only where it is unset (tests, local mode) a temporary folder is made and
    set as the checkpoint folder of this context.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomstone-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """The tasks that so many rows are dealt over: few for few rows, and more than the session's shuffle partitions for many."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))


def dealt(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt over tasks by ``key``, with a column PART that rows of one key share.

    The number of tasks follows the number of rows (``rows``, or as counted),
    so that a task's memory doesn't grow with them where the session's number
    of shuffle partitions stays. Joins and groups whose keys include PART need
    no further shuffle.
    """
    n = tasks_for(df.sparkSession, df.count() if rows is None else rows)
    # More parts than tasks, so that these get about equally many.
    return df.withColumn(PART, F.pmod(F.xxhash64(key), F.lit(16 * n)).cast("int")).repartition(n, PART)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt over tasks by ``keys``, as many as :func:`dealt` takes for ``rows``."""
    return df.repartition(tasks_for(df.sparkSession, rows), *keys)


class Scratch:
    """Written tables in the shared folder, for cutting lineage.

    A table that was written survives the loss of any executor, unlike a
    cached or locally checkpointed one. ``drop`` removes tables that no later
    step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomstone-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        del df
        # The shuffles behind a written table are of no more use; Spark removes
        # their files once the collector has seen that nothing refers to them.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(conf).delete(path, True)
