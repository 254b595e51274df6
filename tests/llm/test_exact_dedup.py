import hashlib

import pytest
from helpers import docs, lower
from pyspark.sql import functions as F

from tallyspan.llm import exact_dedup

ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (7, "é"), (None, "abc"), (None, "only null"), (8, "x" * 200_000), (9, "X" * 200_000)]


def check(rows, got):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] and r["doc_id"] in groups[t])
        ids = [d for d in groups[text] if d is not None]
        assert r["keep_id"] == (max(ids) if ids else None) and r["group_size"] == len(groups[text])
        kept.setdefault(text, []).append(r["doc_id"]) if r["kept"] else None
    assert {t: [max((d for d in g if d is not None), default=None)] for t, g in groups.items()} == kept


def test_decisions(spark):
    check(ROWS, exact_dedup.decide(docs(spark, ROWS)).collect())


def test_full_bytes_part_colliding_digests(spark):
    rows = [(k, f"text {k % 40}") for k in range(120)] + [(3, "text 3")]
    weak = exact_dedup.decide(docs(spark, rows), digest=lambda sha: F.substring(sha, 1, 1))
    check(rows, weak.collect())


def test_state_lasts_between_calls(spark, tmp_path):
    work = f"file://{tmp_path}/work"
    exact_dedup.decide(docs(spark, ROWS[:3]), work=work).collect()
    got = {r["doc_id"]: r["group_size"] for r in exact_dedup.decide(docs(spark, [(20, "ABC"), (21, "new")]), work=work).collect()}
    assert got[20] == 3 and got[1] == 3 and got[21] == 1


def test_drop_copies_keeps_columns_and_one_row(spark):
    d = docs(spark, ROWS)
    left = exact_dedup.drop_copies(d)
    assert left.columns == d.columns
    assert sorted((r["doc_id"] or 0, lower(r["text"])[:9]) for r in left.collect()) == sorted([(2, "abc"), (3, "abc "), (5, ""), (6, "É"), (7, "é"), (0, "only null"), (9, "x" * 9)])


def test_empty(spark):
    assert exact_dedup.decide(docs(spark, [])).count() == 0 and exact_dedup.drop_copies(docs(spark, [])).count() == 0


def weak(sha):
    return F.substring(sha, 1, 1)


@pytest.mark.parametrize("swapped", [False, True])
def test_collisions_between_calls(spark, tmp_path, swapped):
    """Rows of earlier calls are told apart by their bytes, whichever call holds the row that stays, and none goes missing."""
    one, two = [(k, f"text {k % 7}") for k in range(50)], [(k, f"text {k % 9}") for k in range(50, 80)]
    first, second = (two, one) if swapped else (one, two)
    work = f"file://{tmp_path}/work"
    exact_dedup.decide(docs(spark, first), digest=weak, work=work, batch="a")
    check(first + second, exact_dedup.decide(docs(spark, second), digest=weak, work=work, batch="b").collect())
    again = exact_dedup.decide(docs(spark, [(3, "Text 3"), (200, "TEXT 8"), (3, "text 3")]), digest=weak, work=work, batch="c").collect()
    check(first + second + [(3, "Text 3"), (200, "TEXT 8"), (3, "text 3")], again)


def test_repeated_call_lands_once(spark, tmp_path):
    work = f"file://{tmp_path}/work"
    for _ in range(2):
        got = exact_dedup.decide(docs(spark, ROWS), work=work, batch="monday").collect()
        check(ROWS, got)
    for r in got:
        assert r["locator"].startswith("monday/")


def test_dotted_and_clashing_names(spark):
    d = docs(spark, [*ROWS, (7, "É")]).withColumn("a.b", F.lit(1)).withColumn("GONE_ID", F.lit(2)).withColumn("r", F.lit("x"))
    left = exact_dedup.drop_copies(d)
    assert left.columns == d.columns and left.count() == 7


def sizes(rows):
    return {r["text_sha256"]: r["group_size"] for r in rows}


def test_a_call_that_died_while_landing_is_not_read(spark, tmp_path):
    """Batch a without its mark, batch b, then a again: a's rows count once, and only once they have landed whole."""
    work = f"file://{tmp_path}/work"
    a, b = [(1, "same"), (2, "same"), (3, "other")], [(4, "same")]
    digest = lambda sha: sha
    exact_dedup.land(docs(spark, a), f"{work}/landed", digest, "a")
    (tmp_path / "work/landed/batch=a/_SUCCESS").unlink()
    got = exact_dedup.decide(docs(spark, b), work=work, batch="b").collect()
    check(b, got)
    check(a + b, exact_dedup.decide(docs(spark, a), work=work, batch="a").collect())
    assert sizes(exact_dedup.decide(docs(spark, a), work=work, batch="a").collect()) == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in (("same", 3), ("other", 1))}


def test_a_draft_is_no_batch(spark, tmp_path):
    """A write that died before its name was given leaves nothing that a later call reads."""
    work = f"file://{tmp_path}/work"
    exact_dedup.land(docs(spark, [(1, "same")]), f"{work}/landed", lambda sha: sha, "a")
    (tmp_path / "work/landed/batch=a").rename(tmp_path / "work/landed/_draft-batch=a")
    check([(4, "same")], exact_dedup.decide(docs(spark, [(4, "same")]), work=work, batch="b").collect())
    check([(4, "same"), (1, "same")], exact_dedup.decide(docs(spark, [(1, "same")]), work=work, batch="a").collect())


def test_changes_are_compacted(spark, tmp_path):
    """However many calls there were: one snapshot is read, and of the ones before the last stays for results still in use."""
    work, every = f"file://{tmp_path}/work", []
    for k in range(4):
        every += [(k, "same"), (10 + k, f"text {k}")]
        got = exact_dedup.decide(docs(spark, every[-2:]), work=work, batch=f"b{k}")
        check(every, got.collect())
    left = sorted(p.name for p in (tmp_path / "work/updates").iterdir())
    assert len(left) == 2 and all(n.startswith("upto=") for n in left)
