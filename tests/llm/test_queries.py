"""Registered queries against their SQL, and the pipeline's stages one after the other."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import lower, shingles, split
from oracle import compare
from test_mixing import water_fill
from test_quality import plain_selection
from tokenizers import Tokenizer

import corpus_pipeline
from tallyspan.llm import registry
from tallyspan.llm.tokenize import default_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k == 4:
            break
        assert docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert {d for d, _ in rows} <= set(before)
        if name == "exact_deduplication":
            assert len({lower(t) for _, t in rows}) == len(rows)
        if name == "near_deduplication":
            sets = [shingles(t) for _, t in rows]
            assert not [1 for i, x in enumerate(sets) for y in sets[:i] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
        after = rows
    tokenizer = Tokenizer.from_file(default_path())
    tokens = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in after}
    pieces = docs.collect()
    assert sum(p["length"] for p in pieces) == sum(len(tokens[d]) for d, _ in after)
    assert all(p["ids_crc32"] == zlib.crc32(tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "A b C"), (None, "a b c"), (None, None), (5, "word " * 30_000), (6, "é ü " * 40), (6, "other text of the id")]


def odd_docs(spark, rows):
    """Rows with nulls in every column, and extra columns whose names clash with the stages' own or hold a dot."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, Gone_Id string, log_weight string, size string, Near_Gone string, taken string"
    return spark.createDataFrame([(d, t, None, None if k % 2 else "s", None, "x", None, "y", "z", "q", None) for k, (d, t) in enumerate(rows)], schema)


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, tmp_path, number, rows):
    name, stage = corpus_pipeline.STAGES[number]
    d = odd_docs(spark, rows)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, None, 0), (None, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "in" / "labels.parquet"))
    out = stage(spark, d, str(tmp_path / "in"))
    out.write.parquet(str(tmp_path / name))
    left = spark.read.parquet(str(tmp_path / name))
    if number == 4:
        whole = sum(p["length"] for p in left.collect())
        assert whole >= len(rows)
        return
    assert left.columns == d.columns
    ids = [r["doc_id"] for r in left.collect()]
    if name == "quality_classifier":
        assert len(ids) == len(rows)  # labels of one kind tell nothing apart: all stay
    if name == "exact_deduplication":
        assert sorted(map(str, ids)) == sorted(map(str, [2, 4, 5, 6, 6] if rows else []))
    if name == "near_deduplication":
        assert set(ids) == ({1, 2, 3, None, 5, 6} if rows else set())


def plain_pipeline(rows, labels):
    """(doc_id, text) as often as the first four stages keep them, by other code: rows are (doc_id, text, source)."""
    chosen, _ = plain_selection([(d, t) for d, t, _ in rows], labels)
    rows = [r for r in rows if r[0] in chosen]
    last = {}
    for r in rows:
        if lower(r[1]) not in last or last[lower(r[1])][0] < r[0]:
            last[lower(r[1])] = r
    rows = sorted(last.values(), key=lambda r: r[0])
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    target, out = water_fill(sizes), []
    for d, t, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        coin = int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [(d, t)] * (int(rate) + (coin < rate - int(rate)))
    return out


def test_run_equals_plain_versions(spark):
    """The whole pipeline: what each stage keeps, how often the mix takes it, and every token in one place of one sequence."""
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = plain_pipeline(docs, labels)
    assert 0 < len({d for d, _ in want}) < len(docs)
    tokenizer = Tokenizer.from_file(default_path())
    tokens = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in want}
    pieces = corpus_pipeline.run(spark, SF).collect()
    taken = Counter(d for d, _ in want)
    covered = {d: np.zeros(len(tokens[d]), int) for d in taken}
    for p in pieces:
        covered[p["doc_id"]][p["start"] : p["start"] + p["length"]] += 1
        assert p["doc_tokens"] == len(tokens[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert all((covered[d] == n).all() for d, n in taken.items())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 2048
    assert len(sequences) * 2048 <= 1.1 * sum(p["length"] for p in pieces) + 2048
