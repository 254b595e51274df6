"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of target text (documents labelled good) and one of all
raw text, give each document a log importance weight. With Gumbel noise seeded by its id added, the top
k are a sample without replacement. k follows from the corpus: as many as score above the level
that parts good from bad labelled documents best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_name, load, staged
from .tokens import FOLD, M1, SPACE, hashes, mixed, texts

BUCKETS = 1 << 15
#: Labelled documents that the target model is fitted on, and that the level is set on, at most.
MOST_TARGET = 20_000
MOST_CALIBRATION = 20_000
#: Added to each count, once raw counts are brought to the target's total: buckets with few n-grams say little.
PRIOR = 10.0
SEED = 11
BINS = 4096
#: Keys that the search for the k-th largest looks at on the driver, at most.
MOST_KEYS = 10_000

#: 0 white space, 1 letters, digits and all beyond ASCII, 2 other signs.
KIND = np.full(256, 2, np.uint8)
KIND[SPACE] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), ord("_"), *range(128, 256)]] = 1
TWICE = np.uint64(0x5851F42D4C957F2D)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of words and runs of signs, and the text that each is of.

    A word that follows itself makes one bigram of its own kind, whatever the word: repetition is
    a trait of a text that the hash of two words wouldn't show.
    """
    kind = KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    h = hashes(FOLD[data], starts, ends)
    text = np.searchsorted(bounds, starts, "right") - 1
    same = text[1:] == text[:-1]
    pair = np.where(h[1:] == h[:-1], TWICE, mixed(h[:-1] * M1 + h[1:]))[same]
    return (np.concatenate([h, pair]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([text, text[1:][same]])


def count_batches(batches):
    """(bucket, raw, target): n-grams of all texts and of those in ``is_target``."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        chosen = batch.column("is_target").to_numpy(zero_copy_only=False)
        for a, b, data, bounds in texts(batch.column("text")):
            found, text = features(data, bounds)
            raw += np.bincount(found, minlength=BUCKETS)
            target += np.bincount(found[chosen[a:b][text]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def scorer(ratio: np.ndarray):
    """An Arrow function: the log importance weight of each text."""

    @F.arrow_udf("double")
    def log_weight(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for a, b, data, bounds in texts(column):
            found, text = features(data, bounds)
            out[a:b] = np.bincount(text, ratio[found], minlength=b - a)
        return pa.array(out)

    return log_weight


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on key and seed alone."""
    spread = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))), F.lit(1 << 52))
    return -F.log(-F.log((spread + F.lit(0.5)) / F.lit(float(1 << 52))))


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(F.xxhash64(key), key).limit(n)


def best_level(good: np.ndarray, bad: np.ndarray) -> float:
    """The level with the fewest documents on the wrong side, in the middle of where that holds."""
    if not len(good) or not len(bad):
        return -np.inf
    both = np.unique(np.concatenate([good, bad]))
    levels = np.concatenate([[both[0] - 1], (both[1:] + both[:-1]) / 2, [both[-1] + 1]])
    right = len(good) - np.searchsorted(np.sort(good), levels) + np.searchsorted(np.sort(bad), levels)
    best = np.flatnonzero(right == right.max())
    return float(levels[best[len(best) // 2]])


def kth_largest(df: DataFrame, name: str, k: int) -> float:
    """The k-th largest value, by histograms that narrow on it: a few passes over one column."""
    key = F.col(name)
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    while True:
        inside = df.where((key >= lo) & (key <= hi))
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            return lo
        place = F.least(F.floor((key - lo) / width), F.lit(BINS - 1)).cast("int")
        bins = {r["bin"]: r for r in inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b]["n"]:
                break
            k -= bins[b]["n"]
        lo, hi = bins[b]["lo"], bins[b]["hi"]
        if bins[b]["n"] <= MOST_KEYS:
            values = sorted((r[0] for r in df.where((key >= lo) & (key <= hi)).select(key).collect()), reverse=True)
            return values[k - 1]


class Selection:
    """What ``fit`` found: the models' log ratio, and the key that a document needs."""

    def __init__(self, ratio: np.ndarray, level: float, cutoff: float, scores: DataFrame) -> None:
        self.ratio, self.level, self.cutoff, self.scores = ratio, level, cutoff, scores


def log_ratio(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), from counts over all documents."""
    chosen = F.broadcast(target_ids.select(F.col("doc_id").alias("target_id")))  # MOST_TARGET rows at most
    marked = docs.join(chosen, docs["doc_id"] == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("is_target"))
    counts = marked.mapInArrow(count_batches, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log(target + PRIOR) - np.log(raw * (target.sum() / raw.sum()) + PRIOR)


def fit(docs: DataFrame, labels: DataFrame) -> Selection:
    """Models, scores (doc_id, log_weight, gumbel_key) and cut-off for ``docs``.

    ``labels`` has (doc_id, quality 0/1). Half of the labelled ids (by hash) serve the target model, the
    other half sets the level. Without good labels, or without bad ones to tell them from, all stay.
    A null or empty text has weight 0. A null doc_id has noise of its own but no label; ids that
    repeat share their noise and are scored each on its own text.
    """
    docs = docs.select("doc_id", "text")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = staged(known.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))), "quality-labels")
    target = staged(first_by_hash(known.where("half = 0 and quality = 1"), "doc_id", MOST_TARGET), "quality-target")
    ratio = log_ratio(docs, target)
    weight = scorer(ratio)(F.col("text")).alias("log_weight")
    scores = staged(docs.select("doc_id", weight), "quality-scores").withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id")))
    held_out = first_by_hash(known.where("half = 1"), "doc_id", MOST_CALIBRATION).select(F.col("doc_id").alias("held_id"), "quality")
    seen = scores.join(F.broadcast(held_out), scores["doc_id"] == F.col("held_id")).groupBy("held_id").agg(F.min("log_weight").alias("w"), F.min("quality").alias("q")).collect()
    level = best_level(np.array([r["w"] for r in seen if r["q"] == 1]), np.array([r["w"] for r in seen if r["q"] == 0]))
    if not ratio.any() or level == -np.inf:
        return Selection(ratio, -np.inf, -np.inf, scores)
    k = scores.where(F.col("log_weight") >= level).count()
    cutoff = kth_largest(scores, "gumbel_key", k) if k else np.inf
    return Selection(ratio, level, cutoff, scores)


def select_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled rows of ``docs``; same columns. Texts are scored where they lie, without a join."""
    found = fit(docs, labels)
    weight = column_name(docs, "log_weight")
    scored = docs.withColumn(weight, scorer(found.ratio)(docs["text"]))
    return scored.where(F.col(weight) + gumbel(docs["doc_id"]) >= F.lit(float(found.cutoff))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: the documents that stay, with weight and key."""
    found = fit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.scores.where(F.col("gumbel_key") >= F.lit(float(found.cutoff))).select("doc_id", "log_weight", "gumbel_key", F.lit(True).alias("kept"))


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL: dict[str, str] = {}
