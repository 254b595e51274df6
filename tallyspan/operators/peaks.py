"""Ranked peaks per sample and how far the peaks of two samples overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import durable
from .intervals import overlapping

#: Sketched percentiles are off by total / ACCURACY ranks at most; the bracket around a threshold is SLACK times as wide.
ACCURACY, SLACK = 10_000, 4
#: Bases of a cell: rows of one score are numbered cell by cell.
CELL = 1 << 20


def top_fractions(peaks: DataFrame, percents: Sequence[int], score: str = "q") -> DataFrame:
    """``peaks`` in the best floor(total * percent / 100) of their sample, with ``percent``: a row for each that holds.

    Ties go by chromosome, start, end and id. Sketched percentiles bracket each threshold and exact counts say how many rows
    of the bracket are needed (where a sketch should be off, the bracket is the whole sample). Better rows are kept
    without sorting. In the bracket, counts of cells (score, chromosome, stretch) give each cell's first rank, so that rows are
    sorted within cells only: neither a large sample nor one score that all its peaks share is a single task.
    """
    shares = [min(max(1 - p / 100 + side * SLACK / ACCURACY, 0.0), 1.0) for p in percents for side in (-1, 1)]
    bounds = peaks.groupBy("sample").agg(
        F.count(F.lit(1)).alias("_total"), F.percentile_approx(score, F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("_v"), F.min(score).alias("_least"), F.max(score).alias("_most")
    )
    value, below, above = F.col(score), lambda i: F.col("_v")[2 * i], lambda i: F.col("_v")[2 * i + 1]
    counts = peaks.select("sample", score).join(bounds, "sample").groupBy("sample", "_total", "_v", "_least", "_most").agg(
        *[F.count_if(value > above(i)).alias(f"_ahead{i}") for i in range(len(percents))], *[F.count_if(value >= below(i)).alias(f"_upto{i}") for i in range(len(percents))]
    )
    each = []
    for i, p in enumerate(percents):
        wanted = F.floor(F.col("_total") * p / 100)
        held = (F.col(f"_ahead{i}") <= wanted) & (wanted <= F.col(f"_upto{i}"))
        each.append(
            F.struct(
                F.lit(p).alias("percent"), F.when(held, below(i)).otherwise(F.col("_least")).alias("lo"), F.when(held, above(i)).otherwise(F.col("_most")).alias("hi"),
                F.when(held, wanted - F.col(f"_ahead{i}")).otherwise(wanted).alias("need"),
            )
        )
    # sketches differ with the order in which parts are merged: the bracket is worked out once for all that reads it
    limits = durable(counts.select("sample", F.explode(F.array(*each)).alias("_t")))  # a row per sample and percent
    names = peaks.columns
    met = peaks.join(limits, "sample").where(value >= F.col("_t.lo"))
    sure = met.where(value > F.col("_t.hi")).select(*names, "_t.percent")
    maybe = met.where((value <= F.col("_t.hi")) & (F.col("_t.need") > 0)).select(*names, F.col("_t.percent").alias("percent"), F.col("_t.need").alias("_need"), F.floor(F.col("p_start") / CELL).alias("_stretch"))
    cell = ["sample", "percent", score, "chrom", "_stretch"]
    before = Window.partitionBy("sample", "percent").orderBy(F.desc(score), "chrom", "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    cells = maybe.groupBy(*cell, "_need").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = maybe.drop("_need").join(cells.where("_first < _need"), cell)
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("p_start", "p_end", "peak_id"))
    return sure.unionByName(ranked.withColumn("_rank", rank + F.col("_first")).where("_rank <= _need").select(*names, "percent"))


def top_fraction(peaks: DataFrame, percent: int, score: str = "q") -> DataFrame:
    """The best floor(total * percent / 100) peaks of each sample."""
    return top_fractions(peaks, [percent], score).drop("percent")


def sample_pairs(sheet: DataFrame) -> DataFrame:
    """(type, ip, a, b, c1, c2, t1, t2, r1, r2): techniques, cell numbers and replicates to compare; each pair once.

    Controls (IGG, INPUT) and unmerged technical replicates take no part.
    """
    s = sheet.where(~F.col("ip").isin("IGG", "INPUT") & (F.col("tech_rep") == 0))
    # an equi-join for each kind on all that it holds fixed, so that a factor with many samples isn't paired with itself
    merged, cm = F.col("bio_rep") == 0, F.col("technique") == "CM"
    kinds = (
        ("techniques", merged, merged, ["ip", "number_cells"], F.col("x.technique") < F.col("y.technique")),
        ("cells", merged & cm, merged & cm, ["ip", "technique"], F.col("x.number_cells") < F.col("y.number_cells")),
        ("replicates", cm & (F.col("bio_rep") == 1), cm & (F.col("bio_rep") == 2), ["ip", "technique", "number_cells"], F.lit(True)),
    )
    pick = lambda n: [F.col(f"{side}.{c}").alias(f"{k}{i}") for c, k in n for side, i in (("x", 1), ("y", 2))]
    out = None
    for kind, one, two, keys, order in kinds:
        met = F.expr(" AND ".join(f"x.{k} = y.{k}" for k in keys)) & order
        pairs = s.where(one).alias("x").join(s.where(two).alias("y"), met)
        found = pairs.select(F.lit(kind).alias("type"), F.col("x.ip").alias("ip"), F.col("x.sample").alias("a"), F.col("y.sample").alias("b"), *pick((("number_cells", "c"), ("technique", "t"), ("bio_rep", "r"))))
        out = found if out is None else out.unionByName(found)
    return out


def overlap_hits(peaks: DataFrame, pairs: DataFrame, percents: Sequence[int]) -> DataFrame:
    """(a, b, threshold, hits, top): of the top peaks of ``a``, how many overlap any peak of ``b``, for each threshold."""
    top = top_fractions(peaks, percents).select(F.col("sample").alias("a"), "chrom", "peak_id", F.col("percent").alias("threshold"), F.col("p_start").alias("a_start"), F.col("p_end").alias("a_end"))
    totals = top.groupBy("a", "threshold").agg(F.count(F.lit(1)).alias("top"))
    wanted = pairs.select("a", "b").distinct().select("a", "b", F.explode(F.array(*map(F.lit, percents))).alias("threshold"))
    mine = top.join(wanted, ["a", "threshold"])
    theirs = peaks.join(F.broadcast(pairs.select(F.col("b").alias("sample")).distinct()), "sample")  # those of compared samples
    theirs = theirs.select(F.col("sample").alias("b"), "chrom", F.col("p_start").alias("b_start"), F.col("p_end").alias("b_end"))
    hit = overlapping(mine, theirs, keys=["b"])
    hits = hit.groupBy("a", "b", "threshold").agg(F.count(F.lit(1)).alias("hits"))
    joined = wanted.join(totals, ["a", "threshold"], "left").join(hits, ["a", "b", "threshold"], "left")
    return joined.select("a", "b", "threshold", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("top", F.lit(0)).alias("top"))


def overlap_fractions(peaks: DataFrame, pairs: DataFrame, percents: Sequence[int]) -> DataFrame:
    """``pairs`` with overlap, for each threshold: the mean of both directions' share of top peaks that overlap, 1 at most."""
    pairs = pairs.withColumn("_pair", F.struct(F.least("a", "b"), F.greatest("a", "b")))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    share = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("top")), F.lit(0.0))
    mean = overlap_hits(peaks, both, percents).groupBy(F.struct(F.least("a", "b"), F.greatest("a", "b")).alias("_pair"), "threshold").agg(F.avg(share).alias("_mean"))
    return pairs.join(mean, "_pair").withColumn("overlap", F.least("_mean", F.lit(1.0))).drop("_pair", "_mean")


def without_small_replicates(overlaps: DataFrame) -> DataFrame:
    """Drop replicate pairs in which neither side has 10M cells."""
    return overlaps.where(~((F.col("type") == "replicates") & (F.col("c1") != "10M") & (F.col("c2") != "10M")))


def facet_summary(overlaps: DataFrame) -> DataFrame:
    """Mean, number and sample deviation of overlaps per type, factor and threshold."""
    return overlaps.groupBy("type", "ip", "threshold").agg(F.avg("overlap").alias("mean"), F.count(F.lit(1)).alias("n"), F.stddev_samp("overlap").alias("std"))
