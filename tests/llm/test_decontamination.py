import random
import re

import pytest
from helpers import docs, lower, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspan.llm import decontamination

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(WORD, lower(text))


def brute(rows, items, size=10):
    wins = set()
    for item, text in items:
        w = split(text)
        wins |= {(tuple(w[i : i + size]), item) for i in range(max(len(w) - size, 0) + 1)} if w else set()
    out = []
    for d, text in rows:
        w, hit, named = split(text), set(), set()
        for win, item in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    named.add(item)
        places = [(m.start(), m.end()) for m in re.finditer(WORD, lower(text))]
        starts = [k for k in sorted(hit) if k - 1 not in hit]
        spans = [(places[k][0], places[next(j for j in range(k, len(w)) if j + 1 not in hit)][1]) for k in starts]
        out.append((d, len(w), len(hit), sorted(str(x) for x in named if x is not None), spans))
    return sorted(out, key=str)


def found(spark, rows, items, **how):
    item_table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, runs string, `a.b` string")
    got = decontamination.find_leaks(docs(spark, rows), item_table, **how).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], [(s["start"], s["end"]) for s in r["spans"]]) for r in got], key=str)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it sleeps until morning comes again."),
    (2, "Short item"),
    (3, None),
    (4, " ... !"),
    (5, "é ü ñ"),
    (6, "the quick brown fox jumps over the lazy dog and"),
    (7, "a a a a a a a a a a a"),
    (7, "seventh item again"),
    (None, "nobody names me"),
    (10, "short ITEM"),
]
ROWS = [
    (1, "THE quick-brown fox; jumps over the lazy dog and... then IT sleeps"),
    (2, "x short item x item short item"),
    (3, None),
    (4, ""),
    (5, "É é Ü ü ñ \U0001f600 é,ü,ñ"),
    (6, "a " * 30),
    (7, "nobody names me, ever"),
    (7, "the quick brown fox jumps over the lazy cat"),
    (None, "seventh item again"),
    (8, "7 quick 1 brown\x00fox\x7fshort item short\titem"),
    (9, "short " + "w " * 20_000 + "short item"),
]


@pytest.mark.parametrize("most_pairs", [100_000, 4])
def test_equals_brute_force(spark, most_pairs):
    """One automaton, and the same pairs dealt over several."""
    assert found(spark, ROWS, ITEMS, most_pairs=most_pairs) == brute(ROWS, ITEMS)


def test_random_texts(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randrange(1, 30), 40)) for k in range(60)]
    rows = [(k, prose(rng, rng.randrange(80), 40) + " " + rng.choice(items)[1] + "; " + prose(rng, 9, 40)) for k in range(60)]
    assert found(spark, rows, items, size=4) == brute(rows, items, 4)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == []
    assert found(spark, ROWS, []) == brute(ROWS, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), min_size=1, max_size=8), st.lists(st.sampled_from("abcdx"), max_size=30))
def test_automaton_finds_every_occurrence(wins, said):
    pairs = [(" ".join(w), str(k)) for k, w in enumerate(wins)]
    automaton = decontamination.Automaton(pairs)
    digits_of = {w: automaton.read(decontamination.hashes(*(lambda b: (b, *map(decontamination.np.array, ([0], [len(b)]))))(decontamination.np.frombuffer(w.encode(), "u1"))))[0] for w in "abcdx"}
    digits = decontamination.np.array([digits_of[w] for w in said], "u1").reshape(len(said), automaton.width)
    got = {(i, j, automaton.windows[k].decode()) for i, j, k in automaton.hits(digits, lambda i, j: " ".join(said[i : j + 1]).encode())}
    want = {(i, i + len(w) - 1, " ".join(w)) for w in wins for i in range(len(said) - len(w) + 1) if said[i : i + len(w)] == list(w)}
    assert got == want
