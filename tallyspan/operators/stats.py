"""Counts per million, correlations, fragment lengths and their tests."""

from __future__ import annotations

from math import ceil, exp, factorial, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of_total(df: DataFrame, keys: list[str], value: str, name: str, scale: float) -> DataFrame:
    """``value * scale / sum(value)`` per group; totals are joined, so a large group isn't gathered."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return df.join(totals, keys).withColumn(name, F.try_divide(F.col(value) * F.lit(scale), F.col("_total"))).drop("_total")


def counts_per_million(windows: DataFrame) -> DataFrame:
    return share_of_total(windows, ["sample"], "n", "cpm", 1e6)


#: Samples of a tile of the matrix, and windows that are multiplied at a time.
TILE, WINDOWS = 512, 2048
GRAM = "i long, j long, sa double, sb double, saa double, sbb double, sab double, n long"


def pearson_pairs(windows: DataFrame, tile: int = TILE) -> DataFrame:
    """(sample1, sample2, r, n): correlation of each two samples over the windows both have; null if one is constant.

    Values are centred on their sample's mean before squares are summed, so that large counts lose no digits. A task has
    windows whole, multiplies blocks of them into sums for each pair of samples (a Gram matrix), and hands on sums only: no row
    is made for a pair of a window's values. Beyond ``tile`` samples the matrix comes in tiles, each with its own tasks.
    """
    spark = windows.sparkSession
    names = sorted(r["sample"] for r in windows.select("sample").distinct().collect())  # a row per sample, of whose pairs the result has one each
    kind = windows.schema["sample"].dataType.simpleString()
    known = spark.createDataFrame(list(enumerate(names)), f"i long, sample {kind}")
    means = windows.groupBy("sample").agg(F.avg("n").alias("_m")).join(known, "sample")
    centred = windows.join(F.broadcast(means), "sample").select("i", "win", (F.col("n") - F.col("_m")).cast("double").alias("v"))
    tile = max(1, min(tile, len(names)))
    tiles = max(1, -(-len(names) // tile))
    own = F.floor(F.col("i") / tile)
    each = centred.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))) if tiles > 1 else centred.withColumn("_o", F.lit(0).cast("long"))
    dealt = each.select(F.least(own, "_o").alias("ti"), F.greatest(own, "_o").alias("tj"), "win", "i", "v").repartition("ti", "tj", "win").sortWithinPartitions("ti", "tj", "win")
    partial = dealt.select("ti", "tj", F.xxhash64("win").alias("win"), "i", "v").mapInArrow(gram_batches(tile), GRAM)
    sums = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("sa", "sb", "saa", "sbb", "sab", "n")]).where("n > 0")
    n = F.col("n")
    spread = F.sqrt((n * F.col("saa") - F.col("sa") * F.col("sa")) * (n * F.col("sbb") - F.col("sb") * F.col("sb")))
    named = sums.join(F.broadcast(known.select("i", F.col("sample").alias("sample1"))), "i").join(F.broadcast(known.select(F.col("i").alias("j"), F.col("sample").alias("sample2"))), "j")
    return named.select("sample1", "sample2", F.try_divide(n * F.col("sab") - F.col("sa") * F.col("sb"), spread).alias("r"), "n")


def gram_batches(tile: int):
    """Sums over the pairs of samples of each tile, from rows that are ordered by tile and window."""

    def sums_of(ti: int, tj: int, win: np.ndarray, i: np.ndarray, v: np.ndarray) -> np.ndarray:
        row = np.cumsum(np.concatenate([[0], win[1:] != win[:-1]]))
        sides = []
        for t in (ti, tj):
            mine = i // tile == t
            value, there = np.zeros((row[-1] + 1, tile)), np.zeros((row[-1] + 1, tile))
            value[row[mine], i[mine] - t * tile] = v[mine]
            there[row[mine], i[mine] - t * tile] = 1
            sides.append((value, there))
        (x, m), (y, k) = sides
        return np.stack([x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y, m.T @ k])

    def rows(ti: int, tj: int, total: np.ndarray) -> pa.RecordBatch:
        a, b = np.nonzero(total[5])
        upper = ti * tile + a <= tj * tile + b
        a, b = a[upper], b[upper]
        columns = [ti * tile + a, tj * tile + b, *(total[k][a, b] for k in range(5)), total[5][a, b].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in GRAM.split(", ")])

    def of(batches):
        at, total, waiting = None, None, []

        def worked_off(rest: bool):
            """Adds whole windows of what waits to the tile's sums; the last window may go on."""
            nonlocal total, waiting
            win, i, v = (np.concatenate(c) for c in zip(*waiting))
            bounds = np.concatenate([[0], np.flatnonzero(win[1:] != win[:-1]) + 1])
            end = len(win) if rest else bounds[-1]
            for k in range(0, len(bounds), WINDOWS):
                lo, hi = bounds[k], min(bounds[k + WINDOWS] if k + WINDOWS < len(bounds) else len(win), end)
                if lo < hi:
                    total = total + sums_of(*at, win[lo:hi], i[lo:hi], v[lo:hi])
            waiting = [(win[end:], i[end:], v[end:])] if end < len(win) else []

        for batch in batches:
            ti, tj, win, i, v = (batch.column(c).to_numpy() for c in ("ti", "tj", "win", "i", "v"))
            cuts = np.concatenate([[0], np.flatnonzero((ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])) + 1, [len(ti)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if at != (ti[lo], tj[lo]):
                    if at is not None:
                        if waiting:
                            worked_off(True)
                        yield rows(*at, total)
                    at, total, waiting = (int(ti[lo]), int(tj[lo])), np.zeros((6, tile, tile)), []
                waiting.append((win[lo:hi], i[lo:hi], v[lo:hi]))
                if sum(len(w[0]) for w in waiting) > WINDOWS * 64:
                    worked_off(False)
        if at is not None:
            if waiting:
                worked_off(True)
            yield rows(*at, total)

    return of


def melted(pairs: DataFrame) -> DataFrame:
    """(sample1, variable, value): the whole square matrix in long form."""
    upper = pairs.select("sample1", F.col("sample2").alias("variable"), F.col("r").alias("value"))
    lower = pairs.where("sample1 <> sample2").select(F.col("sample2").alias("sample1"), F.col("sample1").alias("variable"), F.col("r").alias("value"))
    return upper.unionByName(lower)


def density2d(windows: DataFrame, a: int, b: int, step: float = 0.5) -> DataFrame:
    """(x, y, n): windows by bins of log2 of two samples' counts; windows without counts are left out."""
    one = windows.where((F.col("sample") == a) & (F.col("n") > 0)).select("win", F.log2("n").alias("la"))
    two = windows.where((F.col("sample") == b) & (F.col("n") > 0)).select("win", F.log2("n").alias("lb"))
    cell = lambda c: F.floor(F.round(F.col(c) / step, 9)).cast("long")
    return one.join(two, "win").groupBy(cell("la").alias("x"), cell("lb").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def smoothed_density(cells: DataFrame, step: float = 0.5) -> DataFrame:
    """(x, y, density): a Gaussian kernel density at every cell between the outermost ones of ``cells`` (x, y, n).

    The kernel is separable, so the plane is smoothed along one axis and then along the other: each row meets the cells of
    its own line only. Bandwidths are the axes' standard deviations times the count to the power -1/6, at least a cell. Cells are
    as many as log counts differ, whatever the number of windows. Densities are per unit of both axes.
    """
    n, at = F.col("n").cast("double"), lambda c: F.col(c).cast("double")
    spread = lambda c: F.sqrt(F.sum(n * at(c) * at(c)) / F.sum(n) - (F.sum(n * at(c)) / F.sum(n)) * (F.sum(n * at(c)) / F.sum(n)))
    wide = lambda c: F.greatest(spread(c) * F.pow(F.sum(n), F.lit(-1 / 6)), F.lit(1.0)).alias(f"h{c}")
    bounds = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum(n).alias("total"), wide("x"), wide("y"))  # one row
    known = cells.join(F.broadcast(bounds))
    bell = lambda a, b, h: F.exp(-(at(a) - at(b)) * (at(a) - at(b)) / (2 * F.col(h) * F.col(h))) / (F.col(h) * F.lit(2.5066282746310002))
    along_x = known.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("v", n * bell("gx", "x", "hx"))
    lines = along_x.groupBy("gx", "y", "y0", "y1", "total", "hy").agg(F.sum("v").alias("v"))
    along_y = lines.withColumn("gy", F.explode(F.sequence("y0", "y1"))).withColumn("v", F.col("v") * bell("gy", "y", "hy"))
    return along_y.groupBy(F.col("gx").alias("x"), F.col("gy").alias("y")).agg((F.sum("v") / F.first("total") / F.lit(step * step)).alias("density"))


#: Draws of a bootstrap.
DRAWS = 200
#: Chances that a Poisson number with mean 1 is at most 0, 1, 2 and so on, up to where the rest is below 1e-9.
AT_MOST = [sum(exp(-1) / factorial(k) for k in range(m + 1)) for m in range(12)]


def bootstrap_means(df: DataFrame, keys: list[str], value: str, row_id: list[str], shares=(0.025, 0.975), draws: int = DRAWS, seed: str = "boot-1") -> DataFrame:
    """keys, n, mean, low, high: means of groups, and percentiles of their means over draws of a Poisson bootstrap.

    In each draw a row counts as often as a Poisson number that its id, the draw and the seed hash to: reruns agree, and sums
    over parts of the data can be added. Rows of equal ids count alike; null values take no part; a group is never gathered.
    """
    rows = df.where(F.col(value).isNotNull())
    # draws are far more work than their rows are bytes, so rows are dealt anew, however few splits they were read in
    dealt = rows.select(*dict.fromkeys([*keys, value, *row_id])).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *row_id)
    each = dealt.select(*keys, F.col(value).cast("double").alias("_v"), F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in row_id]).alias("_id"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    # the hash's first 52 bits stay hexadecimal: digits of equal number compare as numbers do
    hashed = each.withColumn("_h", F.substring(F.md5(F.concat_ws(":", "_id", F.col("_draw").cast("string")).cast("binary")), 1, 13))
    times = F.coalesce(*[F.when(F.col("_h") < f"{ceil(c * (1 << 52)):013x}", F.lit(k)) for k, c in enumerate(AT_MOST)], F.lit(len(AT_MOST)))
    drawn = hashed.withColumn("_k", times).groupBy(*keys, "_draw").agg(F.sum("_k").alias("_times"), F.sum(F.col("_k") * F.col("_v")).alias("_sum"))
    bounds = drawn.groupBy(*keys).agg(F.percentile(F.try_divide(F.col("_sum"), F.col("_times")), list(shares)).alias("_p"))  # a row per draw
    means = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    same = [means[k].eqNullSafe(bounds[k]) for k in keys]
    return means.join(bounds, same).select(*[means[k] for k in keys], "n", "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def fragment_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample", F.abs("tlen").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def fragment_percent(histogram: DataFrame, first: int = 1, last: int = 300) -> DataFrame:
    """Percent of each sample's fragments, the total taken over all lengths before the range is cut."""
    return share_of_total(histogram, ["sample"], "n", "percent", 100.0).where(F.col("length").between(first, last))


def fragment_percentiles(histogram: DataFrame, shares=(0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(sample, share, length): exact percentiles, lengths weighted by their counts."""
    found = histogram.groupBy("sample").agg(F.percentile("length", list(shares), F.col("n")).alias("p"))
    each = F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("p").alias("length")))
    return found.select("sample", each.alias("e")).select("sample", "e.share", "e.length")


def t_tests(histogram: DataFrame, first: int = 1, last: int = 300) -> DataFrame:
    """(sample1, sample2, t, df, p): pooled two-sample tests of lengths, from weighted moments; null where undefined."""
    kept = histogram.where(F.col("length").between(first, last))
    l, n = F.col("length").cast("double"), F.col("n")
    m = kept.groupBy("sample").agg(F.sum("n").alias("k"), F.sum(n * l).alias("s"), F.sum(n * l * l).alias("q"))
    m = m.select("sample", "k", (F.col("s") / F.col("k")).alias("mean"), (F.col("q") - F.col("s") * F.col("s") / F.col("k")).alias("ss"))
    side = lambda i: m.select(*[F.col(c).alias(f"{c}{i}") for c in m.columns])
    pairs = side(1).join(side(2), F.col("sample1") < F.col("sample2"))  # a row per sample on both sides
    df = F.col("k1") + F.col("k2") - 2
    pooled = F.try_divide(F.col("ss1") + F.col("ss2"), df)
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled * (1 / F.col("k1") + 1 / F.col("k2"))))
    tested = pairs.select("sample1", "sample2", t.alias("t"), df.alias("df"))
    return with_p(tested)


#: Terms of the continued fraction; it settles after some multiple of the square root of the degrees of freedom.
TERMS = 2000


def log_gamma(x: Column) -> Column:
    """Stirling's series, shifted up by eight, to ten digits and more."""
    y = x + 8
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - shift


def with_p(tested: DataFrame) -> DataFrame:
    """``tested`` (t, df) with ``p``: what ``two_sided_p`` computes, as an expression; null where t is or df isn't positive."""
    c, real = F.col, F.lit
    df, t = c("df").cast("double"), c("t")
    x = df / (df + t * t)
    turned = x > (df / 2 + 1) / (df / 2 + 2.5)
    parts = {"_a": F.when(turned, 0.5).otherwise(df / 2), "_b": F.when(turned, df / 2).otherwise(0.5), "_x": F.when(turned, t * t / (df + t * t)).otherwise(x), "_turned": turned}
    ready = tested.withColumns(parts)
    a, b, x = c("_a"), c("_b"), c("_x")
    apart = lambda v: F.when(v == 0, 1e-300).otherwise(v)

    def term(state: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        d = F.when(i % 2 == 1, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))).otherwise(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        down, up = 1 / apart(1 + d * state["down"]), apart(1 + d / state["up"])
        return F.struct(up.alias("up"), down.alias("down"), (state["value"] * up * down).alias("value"))

    start = F.struct(real(1.0).alias("up"), real(0.0).alias("down"), real(1.0).alias("value"))
    fraction = F.aggregate(F.sequence(real(1), real(TERMS)), start, term, lambda s: s["value"])
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
    beta = F.when(x <= 0, 0.0).otherwise(front / fraction)
    p = F.when(c("t").isNull() | (c("df") <= 0), None).when(c("t") == 0, 1.0).otherwise(F.when(c("_turned"), 1 - beta).otherwise(beta))
    return ready.withColumn("p", p).drop(*parts)


def two_sided_p(t: float, df: float) -> float:
    """p-value of a t statistic, by the continued fraction of the incomplete beta function."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    """I_x(a, b): what stands before the continued fraction 1 + d1 / (1 + d2 / ...), over its value."""
    if x <= 0:
        return 0.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    up, down, value = 1.0, 0.0, 1.0
    for i in range(1, 2000):
        m = i // 2
        d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if i % 2 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        down = 1 / (1 + d * down or 1e-300)
        up = 1 + d / up or 1e-300
        value *= up * down
        if abs(up * down - 1) < 1e-14:
            break
    return front / value


def wide_histogram(histogram: DataFrame, samples: list) -> DataFrame:
    """(length, one column per sample): all lengths of any sample, missing ones null."""
    return histogram.groupBy("length").pivot("sample", samples).agg(F.first("n"))


def distance_histogram(histogram: DataFrame, first: int = -20, last: int = 1500, marks=(147, 185)) -> DataFrame:
    """Counts in millions within a range of distances, with marked distances flagged."""
    return histogram.where(F.col("length").between(first, last)).select("sample", F.col("length").alias("x"), (F.col("n") / F.lit(1e6)).alias("millions"), F.col("length").isin(*marks).alias("marked"))


