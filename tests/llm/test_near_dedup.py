import random

import numpy as np
from helpers import docs, prose, shingles

from tallyspan.llm import near_dedup
from tallyspan.llm.components import components


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return roots(links, {d for d, _ in rows})


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"c{rng.randrange(9999)}"
    return " ".join(w)


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 60) for _ in range(6)]
    rows = [(k, prose(rng, rng.randrange(1, 80))) for k in range(40)]
    rows += [(100 + k, changed(rng, base[k % 6], rng.randrange(0, 5))) for k in range(150)]
    rows += [(300, None), (301, ""), (302, "  \n"), (303, "one two"), (304, "ONE two"), (305, "one two three"), (306, base[0].upper()), (307, "ab " * 3000)]
    got = near_dedup.decide(docs(spark, rows)).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(shingles(t)) for d, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_large_group_of_borderline_copies(spark):
    """Copies around the threshold: the blocks have to find what the stars don't."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(k, changed(rng, base, rng.randrange(2, 9))) for k in range(260)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.decide(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids(spark):
    rng = random.Random(3)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(5, a), (5, b), (9, a), (11, b), (None, a), (None, None), (9, a)]
    got = near_dedup.decide(docs(spark, rows)).collect()
    assert len(got) == 7
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(5, 5, True), (9, 5, False), (11, 5, False), (None, None, True)}
    d = docs(spark, rows)
    left = near_dedup.drop_near_copies(d)
    assert left.columns == d.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["5", "5", "None", "None"]


def test_empty(spark):
    assert near_dedup.decide(docs(spark, [])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(1)
    links = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(7, 7), (41, 3)] + [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(80)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in roots(links, nodes).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_screen_loses_little_beside_the_bands():
    from math import comb

    below = sum(comb(near_dedup.HASHES, k) * 0.75**k * 0.25 ** (near_dedup.HASHES - k) for k in range(near_dedup.SCREEN))
    assert below < 0.01 * (1 - 0.75**near_dedup.ROWS) ** near_dedup.BANDS
