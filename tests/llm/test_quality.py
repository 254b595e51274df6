import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import docs, prose
from pyspark.sql import functions as F

from tallyspan.llm import quality


def corpus(n=300):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        bad = k % 6 == 0
        text = " ".join(w + "$$$" for w in prose(rng, 60).split()) if bad else prose(rng, 60, 400)
        rows.append((k, text, "s"))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1))
    return rows, labels


def test_good_documents_stay_and_bad_go(spark):
    rows, labels = corpus()
    rows += [(None, None, "s"), (5, rows[5][1], "s"), (900, "", "s")]
    d = docs(spark, rows).withColumn("LOG_weight", F.lit(0))
    l = spark.createDataFrame([*labels, (None, 1), (3, None), (2, 1)], "doc_id long, quality int")
    left = quality.select_documents(d, l)
    assert left.columns == d.columns
    ids = {r["doc_id"] for r in left.collect()}
    good = {r[0] for r in rows if r[0] is not None and r[0] < 300 and r[0] % 6}
    assert len(good - ids) <= 3 and not {k for k in range(0, 300, 6)} & ids
    fitted = quality.fit(d, l)
    assert ids == {r["doc_id"] for r in fitted.scores.where(F.col("gumbel_key") >= fitted.cutoff).collect()}


def test_without_labels_all_stay(spark):
    rows, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.select_documents(docs(spark, rows), none).count() == 20
    assert quality.select_documents(docs(spark, []), none).count() == 0


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest(spark, k, monkeypatch):
    monkeypatch.setattr(quality, "MOST_KEYS", 20)
    values = [float(x) for x in np.random.default_rng(0).normal(size=900)] + [3.25] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_gumbel_noise(spark):
    noise = np.array([r[0] for r in spark.range(20_000).select(quality.gumbel(F.col("id"))).collect()])
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.std() - 1.2825) < 0.04


def test_weights_equal_counts_by_hand(spark):
    """Scores are sums over unigrams and bigrams of the ratio of counts."""
    d = docs(spark, [(1, "a b a!!", "s"), (2, "c c", "s")])
    ids = spark.createDataFrame([(1,)], "doc_id long")
    ratio = quality.log_ratio(d.select("doc_id", "text"), ids)
    import pyarrow as pa

    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for _, _, data, bounds in quality.texts(pa.array(["a b a!!", "c c"])):
        found, text = quality.features(data, bounds)
        assert list(np.bincount(text)) == [7, 3]
        np.add.at(raw, found, 1)
        np.add.at(target, found[text == 0], 1)
    assert np.allclose(ratio, np.log(target + quality.PRIOR) - np.log(raw * 0.7 + quality.PRIOR))


# --- a plain version, word by word in Python's own numbers ------------------------------------------

WIDE = (1 << 64) - 1


def mix(x):
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xC2B2AE3D27D4EB4F)):
        x = (x ^ (x >> shift)) * factor & WIDE
    return x ^ (x >> 32)


def word_hash(word):
    out = mix(len(word))
    for at in range(0, max(len(word), 1), 8):
        out = mix((out + int.from_bytes(word[at : at + 8], "little") * 0xC2B2AE3D27D4EB4F) & WIDE)
    return out


def plain_buckets(text):
    """Runs of letters, digits and bytes beyond ASCII, or of other signs, A-Z lower-cased; pairs of neighbours."""
    data = (text or "").encode()
    runs = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x09-\x0d\x20]+", data)
    found = [word_hash(re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), w)) for w in runs]
    pairs = [0x5851F42D4C957F2D if a == b else mix((a * 0x9E3779B97F4A7C15 + b) & WIDE) for a, b in zip(found, found[1:])]
    return Counter(h % (1 << 15) for h in found + pairs)


def xx(seed, *parts):
    for p in parts:
        seed = xxhash.xxh64(p, seed=seed).intdigest()
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_selection(rows, labels):
    quality_of = {}
    for d, q in labels:
        if d is not None and q is not None:
            quality_of[d] = min(q, quality_of.get(d, q))
    half = {d: signed(xx(42, b"half", struct.pack("<q", d))) % 2 for d in quality_of}
    target_ids = {d for d, q in quality_of.items() if half[d] == 0 and q == 1}
    counts = [(d, plain_buckets(t)) for d, t in rows]
    raw, target = Counter(), Counter()
    for d, c in counts:
        raw.update(c)
        if d in target_ids:
            target.update(c)
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log(target[b] + 10) - math.log(n * share + 10) for b, n in raw.items()}
    weight = [(d, sum(n * ratio[b] for b, n in c.items())) for d, c in counts]
    held = {d: min(w for e, w in weight if e == d) for d in quality_of if half[d] == 1 and any(e == d for e, _ in weight)}
    values = sorted(set(held.values()))
    levels = [values[0] - 1, *[(a + b) / 2 for a, b in zip(values, values[1:])], values[-1] + 1]
    right = [sum((w >= level) == (quality_of[d] == 1) for d, w in held.items()) for level in levels]
    best = [i for i, r in enumerate(right) if r == max(right)]
    level = levels[best[len(best) // 2]]
    spread = lambda d: signed(xx(42, struct.pack("<i", 11), str(d).encode())) % (1 << 52)
    keys = sorted(((w - math.log(-math.log((spread(d) + 0.5) / (1 << 52))), d) for d, w in weight), reverse=True)
    k = sum(w >= level for _, w in weight)
    return {d for _, d in keys[:k]}, dict(weight)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_version(spark, sf):
    """The registered query, whole: counts, weights, level, k, noise and choice by other code."""
    folder = f"/root/testdata/{sf}"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    want, weight = plain_selection(rows, labels)
    got = {r["doc_id"]: r["log_weight"] for r in quality.op5_quality(spark, folder).collect()}
    assert set(got) == want and 0 < len(want) < len(rows)
    assert all(got[d] == pytest.approx(weight[d], abs=1e-6) for d in got)
