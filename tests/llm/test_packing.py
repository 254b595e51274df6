import zlib

import numpy as np
import pytest
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspan.llm import packing
from tallyspan.llm.tokenize import default_path, word_tokenizer

TEXTS = ["hello world", "", None, "It's Über-ſtrange İ ½²3 <|endoftext|> 漢字 ΣΑΣ", "word " * 5000, "x" * 3000, "a b c " * 100]


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(rows, pieces):
    tokenizer = Tokenizer.from_file(default_path())
    for doc, text in rows:
        ids, at = ids_of(tokenizer, text), 0
        for p in sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 2048
    return ends


def test_pieces(spark):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(60)]
    pieces = [r.asDict() for r in packing.pack(docs(spark, rows)).collect()]
    ends = check(rows, pieces)
    assert 1 - sum(ends.values()) / (2048 * len(ends)) < 0.05


def test_one_length_for_all(spark):
    rows = [(k, "cat " * 1500) for k in range(80)]
    ends = check(rows, [r.asDict() for r in packing.pack(docs(spark, rows)).collect()])
    assert 1 - sum(ends.values()) / (2048 * len(ends)) < 0.03


def test_sequences_hold_the_tokens(spark):
    rows = [(k, TEXTS[k]) for k in range(len(TEXTS))]
    d = docs(spark, rows)
    pieces = packing.pack(d)
    found = {r["sequence_id"]: r["ids"] for r in packing.packed_sequences(d, pieces).collect()}
    for p in pieces.collect():
        part = np.array(found[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == p["ids_crc32"]


def test_repeated_null_and_no_rows(spark):
    got = packing.pack(docs(spark, [(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(got) == 3 and sum(r["length"] for r in got) == 3 + 3 + 2
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=40))
def test_quick_tokens_equal_the_tokenizer(text):
    t = word_tokenizer(default_path())
    assert t.encode([text])[0] == t.whole(text)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_crc_join(a, b):
    assert packing.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("seed", range(3))
def test_plan_stays_within_the_histogram(seed):
    rng = np.random.default_rng(seed)
    h = {int(u): int(n) for u, n in zip(*np.unique(rng.integers(1, 257, 3000), return_counts=True))}
    used = {}
    for parts, n in packing.strategies(h):
        assert sum(parts) == 256
        for p in parts:
            used[p] = used.get(p, 0) + n
    assert all(used[u] <= h[u] for u in used)
    assert sum(u * n for u, n in used.items()) > 0.8 * sum(u * n for u, n in h.items())


def test_nnls_finds_an_exact_solution():
    rng = np.random.default_rng(2)
    a, x = rng.random((12, 5)), np.array([1.0, 0, 2, 0, 3])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-5)
