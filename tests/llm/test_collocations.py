import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, lower
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspan.llm import collocations


def brute(rows, support, cover=100):
    """{(lang, phrase): (a, l, r, n, score)} by plain counting."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for size in range(1, 6):
                f.update((lang, w[i : i + size]) for i in range(len(w) - size + 1))
    kept = {k: c for k, c in f.items() if c >= support}
    out = {}
    for (lang, g), a in kept.items():
        if len(g) < 2:
            continue
        if any(l2 == lang and len(h) > len(g) and 100 * c >= cover * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (l2, h), c in kept.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out[lang, " ".join(g)] = (a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score)
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 0, "x", "y", "z") for k, (lang, t) in enumerate(rows)], SCHEMA)


def found(spark, rows, support, **how):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.phrases(table(spark, rows), support, **how).collect()}


def corpus():
    rng = random.Random(3)
    words = ["a", "b", "c", "dd", "é", "Of", "the", "x", "<b>"]
    said = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randrange(120)))) for _ in range(60)]
    said += [("en", "one very common line of twelve words that all of them have! ")] * 40
    return said + [("en", None), (None, None), ("en", ""), ("de", " \t.\n"), ("long", "z y " * 20_000), ("long", "w" * 100_000), ("en", "THE the tHe")]


@pytest.mark.parametrize("hot_least", [200, 1, 5])
def test_equals_brute_force(spark, hot_least):
    """Also where leading words are routed on by more of them."""
    rows = corpus()
    assert found(spark, rows, 8, hot_least=hot_least) == brute(rows, 8)


def test_cover_and_ranks(spark):
    rows = corpus()
    assert found(spark, rows, 20, cover=60) == brute(rows, 20, 60)
    want = brute(rows, 8)
    got = collocations.collocations(table(spark, rows), 8, top=15).collect()
    for lang in {k[0] for k in want}:
        own = sorted((-x[4], -x[0], g.encode()) for (of, g), x in want.items() if of == lang)[:15]
        assert [r["phrase"].encode() for r in sorted(got, key=lambda r: r["rank"]) if r["lang"] == lang] == [x[2] for x in own]
        assert sorted(r["rank"] for r in got if r["lang"] == lang) == list(range(1, len(own) + 1))


def test_empty(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [("en", "too few")])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 3)), max_size=60), st.integers(1, 6))
def test_quicksort_counts_prefixes(suffixes, support):
    w = np.zeros((len(suffixes), 5), np.uint64)
    for i, (s, _) in enumerate(suffixes):
        w[i, : len(s)] = s
    n = np.array([c for _, c in suffixes], np.int64)
    row, size, count = collocations.multikey_quicksort(w, n, support)
    want = Counter()
    for s, c in suffixes:
        for k in range(2, len(s) + 1):
            want[tuple(s[:k])] += c
    got = [(tuple(w[r, :k].tolist()), c) for r, k, c in zip(row.tolist(), size.tolist(), count.tolist())]
    assert len(got) == len(set(got)) and dict(got) == {k: c for k, c in want.items() if c >= support}


def test_scores_beyond_64_bits(spark):
    """Counts of a huge corpus: products of three pass 64 bits."""
    zero = [0, 0, 0]
    phrases = spark.createDataFrame([(1, 2, *zero, 9_000_000_000_001)], "w1 long, w2 long, w3 long, w4 long, w5 long, n long")
    frequent = spark.createDataFrame([("en", "a", 1, 9_876_543_210_987), ("en", "b", 2, 9_012_345_678_901)], "lang string, word string, h long, n long")
    totals = spark.createDataFrame([("en", 98_765_432_109_877)], "lang string, n long")
    r = collocations.scored(phrases, frequent, totals, 100).first()
    assert r["score"] == 1000 * 9_000_000_000_001 * 98_765_432_109_877 // (9_876_543_210_987 * 9_012_345_678_901)


def test_words_of_one_hash_have_rows_of_their_own(monkeypatch):
    """All words of a batch with one hash: each comes out, so that the seed is seen to be unfit."""
    import pyarrow as pa

    real = collocations.hashed_words

    def equal(batch, seed):
        for first, data, starts, stops, at, h, piece in real(batch, seed):
            yield first, data, starts, stops, at, np.ones_like(h), piece

    monkeypatch.setattr(collocations, "hashed_words", equal)
    batch = pa.RecordBatch.from_arrays([pa.array(["aa bb aa cc"]), pa.array(["en"])], ["text", "lang"])
    rows = [r for b in collocations.word_batches(1)([batch]) for r in b.to_pylist()]
    assert Counter((r["word"], r["h"]) for r in rows for _ in range(r["n"])) == {("aa", 1): 2, ("bb", 1): 1, ("cc", 1): 1}
