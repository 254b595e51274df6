"""Sequences of intervals and motif scores along them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import reverse_complement
from ..functions.fixed import MOTIF


def interval_sequences(intervals: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """(name, seq): bases of each interval from chunks (chrom, chunk_start, seq) of ``chunk`` bases; reverse complement on minus.

    An interval meets the chunks it touches by equi-join, takes its part of each, and parts are put together in order.
    Each interval is a row, whatever its name: equal rows give one; null where the reference lacks a base of it; empty ones
    give an empty sequence.
    """
    own = ["name", "chrom", "start", "end", "strand"]
    first, last = F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk)
    touched = F.when(F.col("end") > F.col("start"), F.sequence(first, last))
    wanted = intervals.select(*own, F.explode_outer(touched).alias("_c")).distinct().withColumn("chunk_start", F.col("_c") * chunk)
    met = wanted.join(reference.select("chrom", "chunk_start", "seq"), ["chrom", "chunk_start"], "left")
    lo, hi = F.greatest("start", "chunk_start"), F.least("end", F.col("chunk_start") + chunk)
    part = F.substring("seq", (lo - F.col("chunk_start") + 1).cast("int"), (hi - lo).cast("int"))
    # an interval's parts are as many as its bases need: the list is bounded by its length
    parts = met.select(*own, "_c", part.alias("part")).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("_c", "part"))).alias("ps"))
    seq = F.array_join(F.transform("ps", lambda p: p["part"]), "")
    whole = F.when(F.length(seq) == F.greatest(F.col("end") - F.col("start"), F.lit(0)), seq)
    return parts.select("name", F.when(F.col("strand") == "-", reverse_complement(whole)).otherwise(whole).alias("seq"))


def with_halo(reference: DataFrame, chunk: int, halo: int) -> DataFrame:
    """(chrom, chunk_start, seq): chunks and the first ``halo`` bases of the next one, so that no motif is cut at a seam."""
    if halo > chunk:
        raise ValueError("a chunk has to be as long as what it takes of the next one")
    chunks = reference.select("chrom", "chunk_start", "seq")
    heads = chunks.select("chrom", (F.col("chunk_start") - chunk).alias("chunk_start"), F.substring("seq", 1, halo).alias("_head"))
    joined = chunks.join(heads, ["chrom", "chunk_start"], "left")
    # what a short chunk lacks isn't made up for by the next one
    return joined.select("chrom", "chunk_start", F.concat(F.rpad("seq", chunk, "N"), F.coalesce("_head", F.lit(""))).alias("seq"))


def reversed_motif(motif: dict) -> dict:
    """The motif as it reads on the other strand."""
    return {b: list(motif[c])[::-1] for b, c in zip("ACGT", "TGCA")}


def interval_scores(intervals: DataFrame, reference: DataFrame, chunk: int, motif: dict = MOTIF) -> DataFrame:
    """(name, x, score): the motif's score at every offset of each interval (name, chrom, start, end, strand).

    ``reference`` is (chrom, chunk_start, seq) in chunks of ``chunk`` bases. It is scored where it lies: an interval takes its
    part of each chunk, with the motif's overhang from the next one, and a part is scored by itself, so that an interval as
    long as a chromosome is many tasks. Offsets are numbered along the interval, 0 in the middle (2,000 bases are -990 to
    989 for a motif of 21); minus intervals are read backwards, on the other strand. Each row is an interval, whatever
    its name. Scores are null where a base is missing or none of A, C, G, T; shorter intervals have no rows.
    """
    kind = intervals.schema["name"].dataType.simpleString()
    return interval_parts(intervals, reference, chunk, len(motif["A"])).mapInArrow(part_batches(motif), f"name {kind}, x long, score double")


def score_sums(intervals: DataFrame, reference: DataFrame, chunk: int, motif: dict = MOTIF) -> DataFrame:
    """(x, n, total, best): offsets of ``interval_scores`` by their label, with the sum and the best of their scores at six digits.

    Scores are added up where they are made, in millionths and so exactly: a task hands on a row per label and slice, not per offset.
    """
    parts = interval_parts(intervals, reference, chunk, len(motif["A"])).mapInArrow(sum_batches(motif), "x long, n long, total long, best long")
    sums = parts.groupBy("x").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))
    return sums.select("x", "n", (F.col("total") / 1_000_000).alias("total"), (F.col("best") / 1_000_000).alias("best"))


def interval_parts(intervals: DataFrame, reference: DataFrame, chunk: int, length: int) -> DataFrame:
    """(name, first, step, seq): what each chunk gives an interval, labelled from ``first`` on by ``step``, for a motif of ``length``."""
    halo = length - 1
    # places g of motifs: from start on, up to end - length
    spans = intervals.where(F.col("end") - F.col("start") >= length).select("name", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand")
    touched = F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - length) / chunk))
    wanted = spans.withColumn("_c", F.explode(touched)).withColumn("chunk_start", F.col("_c") * chunk).drop("_c")
    met = wanted.join(with_halo(reference, chunk, halo), ["chrom", "chunk_start"], "left")
    lo = F.greatest("start", "chunk_start")
    n = (F.least(F.col("end") - halo, F.col("chunk_start") + chunk) - lo).cast("int")
    part = F.rpad(F.substring(F.coalesce("seq", F.lit("")), (lo - F.col("chunk_start") + 1).cast("int"), n + halo), n + halo, "N")
    minus = F.col("strand") == "-"
    offset = F.when(minus, F.col("end") - length - lo).otherwise(lo - F.col("start"))
    middle = F.floor((F.col("end") - F.col("start") - halo) / 2)
    return met.select("name", (offset - middle).alias("first"), F.when(minus, -1).otherwise(1).alias("step"), part.alias("seq"))


#: Offsets that are scored at a time.
OFFSETS = 1 << 20


def weight_table(motif: dict) -> np.ndarray:
    weights = np.full((len(motif["A"]), 256), np.nan)
    for base, ws in motif.items():
        weights[:, ord(base)] = ws
    return weights


def scores_of(seqs: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, score) of every offset of all sequences, by one table look-up for each place of the motif."""
    length = len(weights)
    data = [s.encode("ascii", "replace") for s in seqs]
    size = np.array([len(x) for x in data], np.int64)
    n = np.maximum(size - length + 1, 0)
    letters = np.frombuffer(b"".join(data), np.uint8)
    row = np.repeat(np.arange(len(data)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = place + (np.cumsum(size) - size)[row]
    score = np.zeros(len(row))
    for k in range(length):
        score += weights[k][letters[at + k]]
    return row, place, score


def few_at_a_time(batch: pa.RecordBatch, most: int):
    """Slices of a batch whose sequences have so many bases together at most; a longer one goes alone."""
    sizes = np.cumsum([0, *[len(s or "") for s in batch.column("seq").to_pylist()]])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def part_scores(motif: dict):
    """For a batch of parts (name, first, step, seq), strand by strand and slice by slice: rows of the slice, labels, scores and the slice."""
    ahead, back = weight_table(motif), weight_table(reversed_motif(motif))

    def of(batches):
        for whole in batches:
            for batch in few_at_a_time(whole, OFFSETS):
                first, step = (batch.column(c).to_numpy() for c in ("first", "step"))
                seqs = batch.column("seq").to_pylist()
                for weights, way in ((ahead, 1), (back, -1)):
                    own = np.flatnonzero(step == way)
                    row, place, score = scores_of([seqs[k] for k in own], weights)
                    if len(row):
                        yield own[row], first[own[row]] + way * place, score, batch

    return of


def part_batches(motif: dict):
    """Scores of parts: (name, x, score), null where a base is missing; a step backwards is the other strand."""

    def of(batches):
        for row, x, score, batch in part_scores(motif)(batches):
            columns = [batch.column("name").take(pa.array(row)), pa.array(x, pa.int64()), pa.array(score, mask=np.isnan(score))]
            yield pa.RecordBatch.from_arrays(columns, ["name", "x", "score"])

    return of


def sum_batches(motif: dict):
    """Scores of parts by label: (x, n, total, best), in millionths; where no score is known, total and best are null."""

    def of(batches):
        for _, x, score, _ in part_scores(motif)(batches):
            labels, at = np.unique(x, return_inverse=True)
            known = ~np.isnan(score)
            whole = np.floor(score[known] * 1e6 + 0.5).astype(np.int64)
            total, best = np.zeros(len(labels), np.int64), np.full(len(labels), np.iinfo(np.int64).min)
            np.add.at(total, at[known], whole)
            np.maximum.at(best, at[known], whole)
            none = best == np.iinfo(np.int64).min
            columns = [pa.array(labels, pa.int64()), pa.array(np.bincount(at), pa.int64()), pa.array(total, mask=none), pa.array(best, mask=none)]
            yield pa.RecordBatch.from_arrays(columns, ["x", "n", "total", "best"])

    return of


def score_batches(motif: dict):
    """For batches (name, shift, seq): the score of every offset, ``shift`` added to its place."""
    weights = weight_table(motif)

    def of(batches):
        for whole in batches:
            for batch in few_at_a_time(whole, OFFSETS):
                row, place, score = scores_of(batch.column("seq").to_pylist(), weights)
                columns = [batch.column("name").take(pa.array(row)), pa.array(place + batch.column("shift").to_numpy()[row], pa.int32()), pa.array(score, mask=np.isnan(score))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "place", "score"])

    return of


def pwm_scores(sequences: DataFrame, motif: dict = MOTIF, chunk: int = 1 << 16) -> DataFrame:
    """(name, place, score): sum of weights at every offset; null where a base has none, no rows for short or null sequences.

    A sequence is scored by chunks that overlap by the motif's length less one. One that is long in itself belongs into a
    chunked reference, which ``interval_scores`` reads.
    """
    kind, length = sequences.schema["name"].dataType.simpleString(), len(motif["A"])
    long_enough = sequences.where(F.length("seq") >= length)
    starts = long_enough.select("name", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - length, F.lit(chunk))).alias("shift"))
    parts = starts.select("name", "shift", F.substring("seq", F.col("shift") + 1, F.lit(chunk + length - 1)).alias("seq"))
    return parts.mapInArrow(score_batches(motif), f"name {kind}, place int, score double")
