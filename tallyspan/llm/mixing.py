"""Mixing sources to target weights.

Words are summed per source, a repetition rate per source follows from its target, and each
document is taken ``floor(rate)`` times plus once more if a coin seeded by its id says so, with the
fraction of the rate as probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, column_name, load, staged

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
#: 13 hex digits of an MD5, so that a coin is an exact double.
COIN_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, COIN_DIGITS), 16, 10).cast("double") / F.lit(float(16**COIN_DIGITS))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code-point order, null last, get ``weights`` in turn and share the sum of all sizes; a
    target over ``max_repeats`` times its source's size stops there and the others share the excess
    by weight. That ends at one level for all uncapped sources, ``target = level * weight``: with
    sources by rising size per weight, all before some place are capped and the level is what they
    leave over the weights behind. The windows see one row per source, never documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = per_source.withColumn("w", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (place + 1).cast("int")))
    everything = Window.partitionBy()
    # size / weight as size times the other weights: equal ones stay equal as doubles (whole numbers, up to 2^53)
    product = 1
    for w in weights:
        product *= int(w)
    order = Window.orderBy((F.col("source_size") * F.lit(product) / F.col("w")), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    run = (
        weighted.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap", F.col("source_size") * F.lit(int(max_repeats)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
        .withColumn("open", F.col("cap") * F.col("w_left") >= F.col("left") * F.col("w"))
    )
    # the first open source sets the level for itself and all behind it
    level = run.withColumn("first_left", F.first(F.when(F.col("open"), F.col("left")), ignorenulls=True).over(order)).withColumn(
        "first_w", F.first(F.when(F.col("open"), F.col("w_left")), ignorenulls=True).over(order)
    )
    shared = (F.col("w") * F.col("first_left")).cast("double") / F.col("first_w").cast("double")
    return level.select(
        "source", "source_size", F.when(F.col("first_w").isNull(), F.col("cap").cast("double")).otherwise(F.least(shared, F.col("cap").cast("double"))).alias("target")
    )


def copies(size_in_source: Column, target: Column, key: Column, seed: str = SEED) -> Column:
    """How often a document is taken: floor of the rate, and one more with the rest as probability."""
    rate = F.coalesce(F.try_divide(target, size_in_source.cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(coin(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies.

    ``docs`` needs doc_id, text, source; other columns are ignored. A null text has size 0, null
    sources form one source, a null doc_id shares one coin, rows that repeat an id share its coin. A
    source without words gets target 0 and is not taken; an empty table gives an empty plan.
    The texts are read once; what follows works on the narrow table of sizes.
    """
    sizes = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, max_repeats).withColumnRenamed("source", "target_source")
    return sizes.join(targets, sizes["source"].eqNullSafe(targets["target_source"])).select(
        "doc_id", "source", "size", "source_size", "target", copies(F.col("source_size"), F.col("target"), F.col("doc_id"), seed).alias("copies")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; same columns.

    Every row's rate is that of its source, so only the table of sources meets the texts, not the plan.
    """
    sizes = staged(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    source, total, target, again = (column_name(docs, n) for n in ("mix_source", "mix_total", "mix_target", "mix_again"))
    targets = staged(source_targets(sizes, weights, max_repeats), "mix-targets").select(
        F.col("source").alias(source), F.col("source_size").alias(total), F.col("target").alias(target)
    )
    n = copies(F.col(total), F.col(target), docs["doc_id"], seed)
    joined = docs.join(targets, docs["source"].eqNullSafe(targets[source])).withColumn(again, n).where(F.col(again) > 0)
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(again)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(load(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM sizes GROUP BY source),
run AS (
  SELECT *, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS left_over,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS w_left,
         row_number() OVER (ORDER BY source_size * 6 // w, source NULLS LAST) AS place
  FROM src
  WINDOW before AS (ORDER BY source_size * 6 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (
  SELECT min_by(left_over, place) AS first_left, min_by(w_left, place) AS first_w, min(place) AS first_place
  FROM run WHERE cap * w_left >= left_over * w),
tgt AS (
  SELECT source, source_size,
         CASE WHEN first_place IS NULL OR place < first_place THEN CAST(cap AS DOUBLE)
              ELSE least(CAST(w * first_left AS DOUBLE) / CAST(first_w AS DOUBLE), CAST(cap AS DOUBLE)) END AS target
  FROM run CROSS JOIN lvl),
rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / CAST(t.source_size AS DOUBLE) END AS rate,
         CAST(('0x' || substring(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
           / CAST(4503599627370496 AS DOUBLE) AS u
  FROM sizes s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rates
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {"op6_mixing": ORACLE}
