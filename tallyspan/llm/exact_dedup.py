"""Exact deduplication by a stateful stream.

Arrivals land in the shared folder, a batch at a time: digest, stable id, content locator and the bytes that the
locator addresses. The landing folder is read as a stream. A streaming aggregation keyed by digest keeps, in RocksDB
state without expiry, the id that stays, its locator and the size of the group. On hits the full bytes are compared with
those that the state's locator leads to, of whatever call they are, so that a colliding digest can't merge
different texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, column_name, delete, discard, exists, file_system, fresh_path, load, quoted, release, staged

#: State on disk; a partition's store is closed when its task has committed, as no other batch waits for it.
#: All stores of an executor share one bounded cache, and their write buffers are small, however many there are.
ROCKS = "spark.sql.streaming.stateStore.rocksdb"
STATE_CONF = {
    f"{ROCKS}.boundedMemoryUsage": "true",
    f"{ROCKS}.maxMemoryUsageMB": "128",
    f"{ROCKS}.writeBufferSizeMB": "4",
    f"{ROCKS}.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
LANDED = "doc_id long, body string, sha string, digest string, locator string"
ARRIVED = "doc_id long, digest string, locator string"


def body(text: Column) -> Column:
    """What is compared: the text with A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(body(text).cast("binary"), 256)


@contextmanager
def disk_backed_state(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def published(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Names of the folders ``kind=...`` in a folder that were published; leftovers of writes that weren't are deleted."""
    path, system = file_system(spark, folder)
    if not system.exists(path):
        return []
    names = [f.getPath().getName() for f in system.listStatus(path)]
    whole = [n for n in names if n.startswith(f"{kind}=") and exists(spark, f"{folder}/{n}/_SUCCESS")]
    for n in names:
        if n not in whole and n.startswith((f"{kind}=", f"_draft-{kind}=")):
            delete(spark, f"{folder}/{n}")
    return whole


def publish(df: DataFrame, folder: str, name: str) -> str:
    """Write a table aside and give it its name in one step: what dies half-way has no name, and no reader meets it.

    The step is a rename of the file system's: whole or not at all on HDFS and local disks. A store without such a rename
    has ``_SUCCESS`` last, and ``published`` asks for that.
    """
    spark, draft, path = df.sparkSession, f"{folder}/_draft-{name}", f"{folder}/{name}"
    df.write.mode("overwrite").parquet(draft, compression="zstd")
    delete(spark, path)  # of that name only a leftover can be there
    source, system = file_system(spark, draft)
    if not system.rename(source, file_system(spark, path)[0]):
        raise OSError(f"{draft} can't be renamed")
    return path


def land(docs: DataFrame, folder: str, digest: Callable[[Column], Column], batch: str) -> DataFrame:
    """Land the arrivals as a batch, unless it has landed before; all that has landed so far.

    A row's locator is its batch and its number there. A batch is published whole: of a call that died while landing nothing is read,
    and the call can be repeated.
    """
    spark, name = docs.sparkSession, f"batch={batch}"
    if name not in (landed := published(spark, folder, "batch")):
        rows = docs.select("doc_id", body(F.col("text")).alias("body")).withColumn("sha", F.sha2(F.col("body").cast("binary"), 256))
        located = rows.select("*", digest(F.col("sha")).alias("digest"), F.concat(F.lit(f"{batch}/"), F.monotonically_increasing_id().cast("string")).alias("locator"))
        publish(located, folder, name)
        landed.append(name)
    return spark.read.schema(LANDED).parquet(*[f"{folder}/{n}" for n in sorted(landed)])


GROUPS = "digest string, stays struct<doc_id:bigint,locator:string>, group_size long"


def run_stream(spark: SparkSession, landing: str, state: str, out: str) -> DataFrame:
    """Digest groups (digest, keep_id, locator, group_size) once the stream has taken all that has landed.

    ``state`` holds the stream's checkpoint: a later call with the same folders goes on from there. ``out`` holds what micro-batches
    have changed, and snapshots of all groups: a call reads the last snapshot and what changed since, publishes the next one and
    deletes what came before the last, so that it never rereads all calls' changes.
    """
    arrivals = spark.readStream.schema(ARRIVED).parquet(f"{landing}/batch=*")
    groups = arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/update={number}")  # a batch that is run again replaces itself

    with disk_backed_state(spark):
        query = groups.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    number = lambda n: int(n.split("=")[1])
    snapshots = sorted(map(number, published(spark, out, "upto")))
    updates = sorted(map(number, published(spark, out, "update")))
    before, newest = (snapshots or [-1])[-1], max([*updates, *snapshots, -1])
    if newest > before:
        parts = [spark.read.schema(GROUPS).parquet(f"{out}/update={n}").withColumn("update", F.lit(n)) for n in updates if n > before]
        if snapshots:
            parts.append(spark.read.schema(GROUPS).parquet(f"{out}/upto={before}").withColumn("update", F.lit(before)))
        last = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.max_by(F.struct("stays", "group_size"), "update").alias("g"))
        publish(last.select("digest", "g.*"), out, f"upto={newest}")
        for gone in (*(f"update={n}" for n in updates), *(f"upto={n}" for n in snapshots[:-1])):  # results of the call before may still be read
            delete(spark, f"{out}/{gone}")
    every = spark.read.schema(GROUPS).parquet(f"{out}/upto={newest}") if newest >= 0 else spark.createDataFrame([], GROUPS)
    return every.select("digest", F.col("stays.doc_id").alias("keep_id"), F.col("stays.locator").alias("keep_locator"), "group_size")


def collisions(landed: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of digests that several rows have, with their bytes; and the digests whose rows aren't all equal to the one that stays."""
    hits = groups.where("group_size > 1").select("digest", "keep_locator")
    members = staged(landed.select("doc_id", "body", "digest", "locator").join(hits, "digest"), "exact-hits")
    release(landed.sparkSession)
    stay = staged(members.where("locator = keep_locator").select("digest", F.col("body").alias("stay_body")), "exact-stay")
    # both sides staged, and the result before it is made distinct: Spark can then split the join where one group is large
    differ = staged(members.join(stay, "digest").where("body <> stay_body").select("digest"), "exact-collisions")
    discard(stay)
    return members, differ


def decide(docs: DataFrame, digest: Callable[[Column], Column] = lambda sha: sha, work: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Equal are texts that are identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id stays; of rows that repeat id and text one stays. Null ids come last: they
    stay only where a group has no other (keep_id is null then). Empty in, empty out; other columns
    are ignored. ``digest`` makes the state's key of a SHA-256.

    ``work`` is a folder that holds state and contents between calls: ``docs`` are new arrivals then, and the rows and
    decisions are those of all calls. ``batch`` names the arrivals: a call that is repeated with the same name, after a
    failure or not, lands them once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    work = work or fresh_path(spark, "exact-dedup")
    landed = land(docs, f"{work}/landed", digest, batch or uuid.uuid4().hex)
    groups = run_stream(spark, f"{work}/landed", f"{work}/state", f"{work}/updates")
    release(spark)
    members, differ = collisions(landed, groups)

    decided = landed.drop("body").join(groups, "digest")
    if differ.isEmpty():
        discard(members)
    else:  # a digest with several texts: group those by their bytes
        differ = differ.distinct()
        mixed = staged(members.drop("keep_locator").join(differ, "digest", "left_semi"), "exact-mixed")
        by_bytes = mixed.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        again = mixed.join(by_bytes, ["digest", "body"])
        again = again.select("digest", "doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "locator", F.col("stays.doc_id").alias("keep_id"), F.col("stays.locator").alias("keep_locator"), "group_size")
        decided = decided.join(differ, "digest", "left_anti").unionByName(again)
    return decided.select("doc_id", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"), F.col("sha").alias("text_sha256"), "locator")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``decide`` drops; same columns.

    Null texts count as empty, null ids stay only where a group has no other; of rows that repeat id and text one
    stays, whichever if they differ elsewhere. Empty in, empty out.
    """
    spark, work = docs.sparkSession, fresh_path(docs.sparkSession, "exact-dedup")
    decided = staged(decide(docs, work=work), "exact-decided")
    delete(spark, work)  # no later call goes on from this state
    gone = staged(decided.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("rows")).where("not any_kept or rows > 1"), "exact-gone")
    discard(decided)
    release(spark)
    gone_id, gone_sha = column_name(docs, "gone_id"), column_name(docs, "gone_sha")
    sha = sha256(F.col("text"))

    def of(part: DataFrame):
        part = part.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
        return part, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (sha == F.col(gone_sha))

    left = docs.join(*of(gone), "left_anti")
    repeated = gone.where("any_kept")
    if not repeated.isEmpty():  # rows with equal id and text: one of each stays
        names = docs.columns
        first = docs.join(*of(repeated), "left_semi").select(F.struct(*[F.col(quoted(c)) for c in names]).alias("r"), F.col("doc_id").alias("k"), sha.alias("s"))
        left = left.unionByName(first.groupBy("k", "s").agg(F.first("r").alias("r")).select(*[F.col("r").getField(c).alias(c) for c in names]))
    return left


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(load(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
             row_number() OVER (PARTITION BY body, doc_id) AS copy FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
       (doc_id IS NOT DISTINCT FROM keep_id) AND copy = 1 AS kept, sha256(body) AS text_sha256
FROM g
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE_SQL = {"op7_exact_dedup": ORACLE}
