"""Tables that plans read several times, kept where a lost executor doesn't lose them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set as Spark's checkpoint folder.

    Where it is unset, a temporary one is made if all of Spark is this process; on a cluster that is an error, as
    executors don't share local folders.
    """
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not given and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not given:
        given = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", given)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder: computed once, and its lineage cut."""
    folder(df.sparkSession)
    return df.checkpoint()
