"""Sources: sheets, intervals, coverage, tracks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import strand
from . import schemas


def read_sheet(spark: SparkSession, path: str, schema: str = schemas.SAMPLE_SHEET) -> DataFrame:
    """A sheet with a header line; carriage returns alone end lines too, empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def read_tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Tab-separated columns by position, without a header."""
    return spark.read.schema(schema).csv(path, sep="\t")


def read_peaks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Narrow or broad peaks by file name (broadPeak has no summit), or BED; strands as +, - or . for none.

    Files of one kind are one scan. A list of several kinds has the columns of all, null where a kind has none.
    """
    by_kind: dict[str, list[str]] = {}
    for p in [path] if isinstance(path, str) else path:
        name = p.rstrip("/").rsplit("/", 1)[-1]
        by_kind.setdefault(schemas.BROAD_PEAK if "broadPeak" in name else schemas.NARROW_PEAK if "narrowPeak" in name else schemas.BED, []).append(p)
    parts = [read_tsv(spark, ps, kind) for kind, ps in by_kind.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("strand", strand(F.col("strand")))


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            found.append(p)
    return found


def read_coverages(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Window coverage of many samples in one scan: sample (file name up to the first dot), chrom, start, end, n.

    Samples whose file is missing are skipped.
    """
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "sample string, " + schemas.WINDOW_COVERAGE)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/]*)?$", 1)
    return read_tsv(spark, found, schemas.WINDOW_COVERAGE).select(name.alias("sample"), "*")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Browser tracks: one line each, attributes as key=value, some quoted."""
    lines = spark.read.text(path).where(F.col("value").startswith("track "))
    return lines.select(*[track_attribute(F.col("value"), k).alias(k) for k in ("type", "name", "description", "height", "visibility", "maxHeightPixels", "bigDataUrl", "color")])


def track_attribute(line, key: str):
    found = F.coalesce(F.nullif(F.regexp_extract(line, rf" {key}='([^']*)'", 1), F.lit("")), F.nullif(F.regexp_extract(line, rf" {key}=([^' ]\S*)", 1), F.lit("")))
    return found.cast("int") if key == "height" else found
