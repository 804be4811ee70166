"""Helpers shared by the corpus operators."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six characters that part words: space and U+0009 to U+000D. bytes.split() parts at the same ones.
SPACE = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where the session names none, as in tests, a temporary one is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and cut the lineage, so that a lost executor costs no earlier stage.

    Spark removes the files when the frame is no longer used, if
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ascii_lower(column):
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())
