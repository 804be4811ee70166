"""Lazy access to the parquet tables of one data directory."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


class Tables:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # Rows here are small but cost CPU: let a small shuffle still use every slot.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the session's spark.checkpoint.dir; only where none is named, as in tests, a local one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, lineage cut, survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a table that is sent to every task, at most.
MOST_SENT = 100_000


def lookup(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A table, computed once, to join many rows with: sent to every task where it is small, else both sides are shuffled.

    Left to itself Spark goes by the size of files and may send the other side: rows exploded out of a small file.
    """
    rows = keep(df)
    return sent(rows, most) or rows.hint("merge")


def sent(rows: DataFrame, most: int = MOST_SENT) -> DataFrame | None:
    """A table that is cheap to read, marked to be sent to every task; none if it has more than `most` rows."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else None


def slots(df: DataFrame) -> int:
    """Tasks the cluster runs at once; at least the session's shuffle width."""
    session = df.sparkSession
    return max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the scan has fewer splits than the cluster has slots.

    A big table already arrives in many splits and is left alone, so this adds
    no shuffle at scale; it only stops one small file from pinning CPU-heavy
    work to a single task.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)
