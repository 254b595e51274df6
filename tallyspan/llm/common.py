"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from time import sleep

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Texts are long: Arrow batches of Spark's default number of rows would take much of an executor's memory.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPARKS_OWN, OURS = "10000", "1000"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless its owner has set a size."""
    if spark.conf.get(BATCH_ROWS, SPARKS_OWN) == SPARKS_OWN:
        spark.conf.set(BATCH_ROWS, OURS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent (tests) a temporary folder is made if all of Spark is this process. On a cluster that
    is an error: each executor would write to a disk of its own, and later reads would miss rows.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    bound_batches(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage in a way that outlives executors, and gives Catalyst true sizes.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it is on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = file_system(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, system = file_system(spark, path)
    system.delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again (a round's table once the next is written)."""
    files = df.inputFiles()
    if files:
        delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It does so once the driver's collector finds that no plan needs them, which on an idle driver can take half an hour.
    """
    for _ in range(2):  # what the first finds holds on to what the second finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        sleep(0.3)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null.

    Where a text is plain ASCII, ``lower`` does just that and is much faster.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def column_name(df: DataFrame, base: str) -> str:
    """A name for a helper column that clashes with none of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
