import numpy as np
from pyspark.sql import functions as F

from tallyspan.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, id int"


def rows(x, start=0):
    return [(start + k, [float(np.float32(v)) for v in r], 0, "x", 1) for k, r in enumerate(x)]


def brute(data, q, k=10):
    x = np.array([r[1] for r in data])
    ids = np.array([r[0] for r in data])
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    keep = ids != q
    order = np.lexsort((ids[keep], d[keep]))[:k]
    return ids[keep][order].tolist(), d[keep][order]


def test_recall_scores_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 300 * 24 * 8)
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 4 * 24 * 8)
    rng = np.random.default_rng(1)
    data = rows(rng.normal(size=(1500, 24)))
    df = spark.createDataFrame(data, SCHEMA)
    got = neighbours.nearest(df, df.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding").collect()
    hits = 0
    for q in range(0, 1500, 100):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        ids, d = brute(data, q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        hits += len({m[1] for m in mine} & set(ids))
    assert hits / 150 >= 0.9


def test_copies_ties_and_few_candidates(spark):
    x = np.zeros((40, 4)) + [1, 0, 0, 0]
    x[5] = [0, 1, 0, 0]
    df = spark.createDataFrame(rows(x), SCHEMA)
    got = neighbours.nearest(df, df.where("vec_id = 0"), "vec_id", "embedding").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    few = spark.createDataFrame(rows(np.eye(3)), SCHEMA)
    assert neighbours.nearest(few, few, "vec_id", "embedding").count() == 6


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(10, None, 0, "", 0), (11, [0.0, 0.0], 0, "", 0), (12, [nan, 1.0], 0, "", 0), (13, [inf, 1.0], 0, "", 0), (14, [None, 1.0], 0, "", 0), (None, [1.0, 1.0], 0, "", 0), (15, [1.0, 2.0, 3.0], 0, "", 0), (16, [], 0, "", 0)]
    df = spark.createDataFrame([*rows(np.eye(2)), *odd], SCHEMA)
    got = neighbours.nearest(df, df, "vec_id", "embedding").collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(0, 1), (1, 0)}
    assert neighbours.nearest(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def test_probing_is_complete():
    """Every code within the radius is retrieved."""
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, neighbours.PARTS), dtype=np.uint8)
    block = neighbours.Block(codes)
    for radius in (0, 9, 20, 31, 64):
        near = codes[7] ^ np.array([1, 3, 0, 0, 7, 0, 255, 0], np.uint8)
        want = np.flatnonzero(neighbours.POPCOUNT[codes ^ near].sum(axis=1) <= radius)
        assert block.within(near, radius).tolist() == want.tolist()


def test_repeated_rows(spark):
    """A query that comes twice is answered once; rows that repeat another id are each a candidate."""
    x = np.random.default_rng(4).normal(size=(30, 6))
    df = spark.createDataFrame([*rows(x), *rows(x[:1]), *rows(x[5:6], 5)], SCHEMA)
    got = neighbours.nearest(df, df.where("vec_id = 0"), "vec_id", "embedding").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11)) and 0 not in {r["vec_id"] for r in got}
    data = [*rows(x), *rows(x[5:6], 5)]
    d = np.sqrt(((np.array([r[1] for r in data]) - np.array(data[0][1])) ** 2).sum(axis=1))
    want = sorted((s, data[i][0]) for i, s in enumerate(d) if i)[:10]
    assert [r["vec_id"] for r in got] == [i for _, i in want]
