import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspan.llm import alignment

PATHS = alignment.default_paths()
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def signs():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


SIGNS = signs()


def tokens(text):
    """(id, end) of both tokenizers for the whole text, by the lengths of decoded bytes alone; None without tokens."""
    if not text:
        return None
    want, out = (" " + text).encode(), []
    made = A.encode(" " + text, add_special_tokens=False)
    for ids, parts in (
        (made.ids, [bytes(SIGNS[c] for c in t) for t in made.tokens]),
        (ids := B.encode(text), [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(B.id_to_piece, ids))]),
    ):
        if b"".join(parts) != want:
            return None
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        out.append(list(zip(ids, ends)))
    return out


def plain_groups(text):
    found = tokens(text)
    if not found:
        return None
    a, b = found
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    groups, before = [], 0
    for cut in cuts:
        groups.append(([i for i, e in a if before < e <= cut], [i for i, e in b if before < e <= cut]))
        before = cut
    return groups


def brute(texts):
    groups = [plain_groups(t) for t in texts]
    count = Counter((g[0][-1], g[1][-1]) for gs in groups if gs for g in gs)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for gs in groups:
        if gs is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(g[0][-1], g[1][-1]) for g in gs]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        sums = sum(count[p] for p in pairs)
        out.append((sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(gs), sum(count[p] == highest[p[1]] for p in pairs), sums, hashlib.sha256(said.encode()).hexdigest()))
    return out


TEXTS = [
    None,
    "",
    " ",
    "  two  spaces   and a tail  ",
    "Hello, world! It's here; they'll see 'tis 12345 done.",
    "héllo wörld\n 中国 \U0001f600\U0001f468‍\U0001f469 ok ＡＢ ☃",
    "a▁b has the piece mark",
    "tabs\tand\r\nlines {\r\n}\r next();\r\n\r\n  x \r y",
    "a\x00b \x1c\x1f.\x1c \x85 \xa0x　 y",
    "<s> hi</s> <unk> <|endoftext|> <0x41>",
    "word " * 3000,
    "x" * 300 + " " + "ü" * 200,
    "é ﬁ \U00010348 �",
    "the same text twice",
    "the same text twice",
    "\n\nstarts with lines",
    "ends with a line\n",
]


@pytest.mark.parametrize("sent", [1 << 20, 20, 0])
def test_equals_brute_force(spark, sent):
    """All pairs sent, a few, none."""
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(4, "Hello, world!"), (None, "Hello, world!")]
    got = alignment.align(docs(spark, rows), sent=sent).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = [(d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows]))]
    assert sorted([(r["doc_id"], *(r[n] for n in names)) for r in got], key=str) == sorted(want, key=str)


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in alignment.align(table).collect()}
    for r, x in zip(rows, brute([r["text"] for r in rows])):
        g = got[r["doc_id"]]
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["n_best"], g["count_sum"], g["groups_sha256"]) == x


def test_groups_and_empty(spark):
    got = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in alignment.aligned_groups(docs(spark, list(enumerate(TEXTS)))).collect()}
    assert got == {k: plain_groups(t) or [] for k, t in enumerate(TEXTS)}
    assert alignment.align(docs(spark, [])).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r'▁.aé中\x85\x1c　sS1")), max_size=40))
def test_chunks_give_what_whole_texts_give(text):
    made = alignment.aligner(PATHS)
    assert made.by_chunks
    said = ";".join(p.groups for p in made.parts([text])[0])
    groups = plain_groups(text)
    assert said == (";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups) if groups else "")
    for clip in (made.tokens_a(" " + text), made.tokens_b(" " + text)) if groups else ():
        assert clip is not None
    if groups:
        want = tokens(text)
        assert [list(zip(x[0].tolist(), x[1].tolist())) for x in (made.tokens_a(" " + text), made.tokens_b(" " + text))] == want
