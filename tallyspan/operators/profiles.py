"""Smoothing and second normalisation of position profiles in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import kernel
from .checkpoints import durable


def smooth(series: DataFrame, keys: Sequence[str], place: str, value: str, width: int = 11, window: str = "hanning", centred: bool = False) -> DataFrame:
    """Kernel smoothing with mirrored ends of all series at once: keys, ``place``, ``value``.

    ``place`` numbers each series from 0 without gaps. Ends are mirrored, the left without its edge value and the right
    with it, so n values give n + width - 1; ``centred`` keeps the n in the middle. A width under 3 changes nothing.
    Series shorter than the width raise an error. Every value meets the kernel's few weights where it lies.
    """
    weights = kernel(window, width)
    if width < 3:
        return series.select(*keys, place, value)
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = series.join(sizes, list(keys))
    checked = F.when(F.col("_n") >= width, F.col(place)).otherwise(F.raise_error(F.lit("a series is shorter than the kernel")).cast("long"))
    p, n = F.col("_p"), F.col("_n")
    spots = F.array(
        p, F.when((p >= 1) & (p <= width - 1), -p), F.when(p >= n - width + 1, 2 * n - 1 - p)
    )
    copies = sized.select(*keys, "_n", checked.cast("long").alias("_p"), F.col(value).alias("_v")).select(*keys, "_n", "_v", F.explode(F.filter(spots, lambda s: s.isNotNull())).alias("_at"))
    kernel_rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in enumerate(weights)])
    terms = copies.select(*keys, "_n", "_v", "_at", F.explode(kernel_rows).alias("_k"))
    j = F.col("_at") + (width - 1) - F.col("_k.t")
    out = terms.select(*keys, "_n", j.alias("_j"), (F.col("_k.w") * F.col("_v")).alias("_y")).where("_j >= 0 and _j <= _n + %d" % (width - 2))
    sums = out.groupBy(*keys, "_n", "_j").agg(F.sum("_y").alias(value))
    half = (width - 1) // 2
    if centred:
        return sums.where(f"_j >= {half} and _j < _n + {half}").select(*keys, (F.col("_j") - half).alias(place), value)
    return sums.select(*keys, F.col("_j").alias(place), value)


def over_background(profile: DataFrame, control: int | str) -> DataFrame:
    """(sample, x, average): averages over exp of the control's average at the same position."""
    background = profile.where(F.col("sample") == control).select("x", F.col("average").alias("c"))
    return profile.where(F.col("sample") != control).join(background, "x").select("sample", "x", (F.col("average") / F.exp("c")).alias("average"))


def profile_types(profile: DataFrame, control: int | str, reach: int = 400, width: int = 11) -> DataFrame:
    """(sample, type, x, average) for types raw, rawSmooth, norm, normSmooth, positions within ``reach``.

    The background's own raw profiles stay. Smoothed profiles are ``width - 1`` longer and centred on 0.
    """
    raw = profile.where(F.col("x").between(-reach, reach)).select("sample", "x", "average")
    raw = durable(raw)  # a few rows for each sample, read six times
    norm = over_background(raw, control)
    at = F.col("x") + reach

    def smoothed(p: DataFrame) -> DataFrame:
        flat = smooth(p.select("sample", at.alias("place"), "average"), ["sample"], "place", "average", width)
        return flat.select("sample", (F.col("place") - F.lit((2 * reach + width) // 2)).alias("x"), "average")

    parts = (("raw", raw), ("rawSmooth", smoothed(raw)), ("norm", norm), ("normSmooth", smoothed(norm)))
    out = None
    for kind, p in parts:
        p = p.select("sample", F.lit(kind).alias("type"), "x", "average")
        out = p if out is None else out.unionByName(p)
    return out
