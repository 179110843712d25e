"""What the library reads from a running session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and the master is local, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    A cluster has to name it; only a local master, whose threads share the
    machine's disk anyway, falls back to :data:`LOCAL_SHARED`.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = LOCAL_SHARED
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark)}/lumenweave/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    Unlike a checkpoint, which keeps the estimates of the plan it came from, the
    table has its own size: in a loop of joins the estimates don't multiply.
    """
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with all of a key in one partition, sorted by key and ``order``, for a fold over batches.

    Dealt by a hash of the key and not by the key itself: what a join or a union has
    dealt by it already counts as done, and is then split or put together anew by each
    input's sizes, which a fold doesn't forbid as an aggregate would.
    """
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def text_batches(spark: SparkSession, most: int = 1000) -> None:
    """Whole texts go to Python some at a time: a batch of Spark's usual 10,000 rows would be tens of MB in every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
