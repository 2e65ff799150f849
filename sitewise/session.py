"""Where intermediate tables are settled, and how their size is checked."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest table this library is willing to broadcast, in rows. Every broadcast is
# preceded by a count against it (or by an argument that fixes the row count).
BROADCAST_ROWS = 10_000
# Rows of documents that travel between the JVM and a Python worker at a time.
ARROW_ROWS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """Folder for settled tables: the cluster's setting, or a scratch one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and pins values that must not change when a task is retried
    (range-partition ids, iteration state). Being a table in shared storage it
    survives the loss of any executor, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallel_tasks(spark: SparkSession) -> int:
    """Task count for stages whose work is far larger than their bytes.

    The planner sizes tasks by bytes and would run such a stage in one or two tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def short_batches(spark: SparkSession) -> None:
    """At most ARROW_ROWS rows in an Arrow batch of this session; a smaller setting stays.

    By default a batch has 10,000 rows, which is all the text of a small split. The JVM and the worker each hold it
    beside the heap, and Spark has no such setting for a single frame."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if not 0 < rows <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)
