"""Sample sheets and quality tables: filters, derived columns, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ("cell_line", "number_cells", "technique", "ip", "treatment", "bio_rep", "genome")


def relabel_singletons(sheet: DataFrame, keys=GROUP) -> DataFrame:
    """Technical replicate 0 (merged) for samples that have no other in their group; null keys are equal.

    Group sizes are aggregated and joined back null-safely, so that one large group isn't gathered.
    """
    sizes = sheet.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_n")
    same = [sheet[k].eqNullSafe(sizes[f"_{k}"]) for k in keys]
    joined = sheet.join(sizes, same)
    return joined.select(*[F.when(F.col("_n") == 1, 0).otherwise(F.col("tech_rep")).alias(c) if c == "tech_rep" else sheet[c] for c in sheet.columns])


def named_factors(sheet: DataFrame, pattern: str) -> DataFrame:
    """Rows whose factor matches a pattern; rows without one are dropped."""
    return sheet.where(F.col("ip").rlike(pattern))


def comparable_samples(sheet: DataFrame, pattern: str = "CTCF|GATA1|PU1|REST") -> DataFrame:
    """Untreated samples of the named factors, controls left out."""
    return named_factors(sheet, pattern).where(F.col("treatment").isNull() & (F.col("ip") != "IGG") & (F.col("ip") != "INPUT"))


def override(df: DataFrame, key: str, column: str, replacements: DataFrame) -> DataFrame:
    """``column`` from ``replacements`` (key, column) where it has the key."""
    new = replacements.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    joined = df.join(new, df[key] == new["_key"], "left")
    return joined.select(*[F.coalesce("_new", column).alias(c) if c == column else df[c] for c in df.columns])


def frip_table(qc: DataFrame) -> DataFrame:
    """(technique, ip, peak_number, frip, log_peaks): complete rows with FRiP under 1.05; values over 1 become -0.05."""
    kept = qc.select("technique", "ip", "peak_number", "frip").na.drop().where("frip < 1.05")
    return kept.withColumn("frip", F.when(F.col("frip") > 1, F.lit(-0.05)).otherwise(F.col("frip"))).withColumn("log_peaks", F.when(F.col("peak_number") > 0, F.log10("peak_number")))


def titration_table(stats: DataFrame, lookup: DataFrame, pattern: str) -> DataFrame:
    """Rows whose factor matches, with what the titration table says of their technique and the unmapped percentage."""
    named = stats.where(F.col("ip").rlike(pattern))
    return named.join(lookup, "technique").withColumn("percent_unmapped", 100 - F.col("percent_aligned"))


def metagene_long(matrix: DataFrame, index: str, series: list[str]) -> DataFrame:
    """(index, series, value): a wide matrix with one column per series in long form."""
    return matrix.unpivot([index], series, "series", "value")
