import pytest
from helpers import docs, split
from pyspark.sql import functions as F

from tallyspan.llm import mixing


def water_fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again what capped sources leave."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 7, None: 40}, {"a": 10}, {"z": 1, "Z": 1000, "é": 3, "y": 0}, {"a": 6, "b": 12, "c": 18}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_plan_and_mix_agree(spark):
    rows = [(k, "w " * (k % 13), f"s{k % 4}" if k % 9 else None) for k in range(400)] + [(None, "a b c", "s1"), (5, "\t x\n", "s2"), (7, None, "s9")]
    d = docs(spark, rows).withColumn("mix_again", F.lit(1))
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == len(rows)
    assert sum(r["size"] for r in plan) == sum(len(split(t[1])) for t in rows)
    assert all(r["copies"] <= 3 for r in plan)
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    assert mixed.count() == sum(r["copies"] for r in plan)
    again = mixing.mix_plan(d.repartition(7)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_taken_words_come_near_targets(spark):
    rows = [(k, "w " * (1 + k % 17), f"s{k % 3}" if k % 3 == 0 else "big") for k in range(6000)]
    plan = mixing.mix_plan(docs(spark, rows)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"))
    for r in plan.collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.06)


def test_empty(spark):
    assert mixing.mix_plan(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, "")])).count() == 0
