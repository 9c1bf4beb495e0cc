"""Small helpers of the llm operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local session (tests) makes a temporary one; a cluster must name one.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the cluster's shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def words_of(text):
    """Column: the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def salted(df: DataFrame, salts: int) -> DataFrame:
    """``df`` once for each salt 0 .. salts-1, for joins in which a key of the other side may be hot."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
