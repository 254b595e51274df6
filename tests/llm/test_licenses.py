import random
import textwrap
from collections import defaultdict

import pytest
from helpers import docs, prose

from tallyspan.llm import licenses

rng = random.Random(1)
PROSE = [prose(rng, 30) for _ in range(200)]


@pytest.fixture(scope="module")
def model():
    return licenses.train(PROSE)


def test_every_template_is_found_and_prose_is_not(spark, model):
    rows, want = [], {}
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            k = len(rows)
            rows.append((k, f"é {PROSE[k % 90]}\n{t}\n{PROSE[3]}"))
            want[k] = (family, t)
    rows += [(1000 + k, p + "\n" + p) for k, p in enumerate(PROSE[:60])]
    rows += [(2000, "The license of the software is under the public version of the work."), (2001, "MIT is a university; the Apache are a people.")]
    got = {r["doc_id"]: r for r in licenses.find_licences(docs(spark, rows), model).collect()}
    right = sum(got[k]["family"] == f for k, (f, _) in want.items() if k in got)
    assert right >= len(want) - 2 and not [k for k in got if k >= 1000]
    text = dict((r[0], r[1]) for r in rows)
    for k, r in got.items():
        assert text[k][r["start"] : r["end"]] == want[k][1] and r["paragraph"] == 1 and r["similarity"] == 1


def test_held_out_accuracy(model):
    """Noisy copies that training didn't see."""
    fresh = random.Random(9)
    right = total = 0
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            ws = licenses.tokens(t)
            if len(ws) < 6:
                continue
            for _ in range(10):
                noisy = [w if fresh.random() > 0.1 else "zzz" for w in ws]
                total += 1
                right += model.predict(noisy)[0] == family
    assert right / total > 0.85
    unknown = [model.predict(licenses.tokens(prose(fresh, 25)))[0] for _ in range(200)]
    assert unknown.count(licenses.UNKNOWN) >= 198


def test_nulls_empty_repeats(spark, model):
    line = "Released under the MIT License."
    got = licenses.find_licences(docs(spark, [(None, line), (1, None), (2, ""), (3, line), (3, line), (4, "\n\n" + line + "\n" + line)]), model).collect()
    assert sorted(str((r["doc_id"], r["paragraph"])) for r in got) == sorted(map(str, [(None, 0), (3, 0), (3, 0), (4, 2), (4, 3)]))
    assert licenses.find_licences(docs(spark, [])).count() == 0


def test_all_rights_reserved(spark):
    """Also where the background holds the notice, as in the test tables."""
    rows = [(k, p + ("\nAll rights reserved." if k % 5 == 0 else "")) for k, p in enumerate(PROSE)]
    got = licenses.find_licences(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 200, 5))
    assert {(r["family"], r["template"], r["paragraph"], r["similarity"]) for r in got} == {("proprietary", "All rights reserved.", 1, 1)}


@pytest.mark.parametrize("width, mark", [(72, ""), (40, " * "), (60, "# ")])
def test_wrapped_notices(spark, model, width, mark):
    """Templates of more than one line, between prose and blank lines, with what the span and the paragraph have to be."""
    rows, want = [], {}
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            lines = textwrap.wrap(t, width)
            if len(lines) < 2:
                continue
            k = len(rows)
            notice = "\n".join(mark + x for x in lines)
            rows.append((k, f"é {PROSE[k % 90]}\n\n{notice}\n\n{PROSE[3]}"))
            want[k] = (family, notice)
    rows += [(500, rows[0][1].split("\n\n")[1].split("\n")[0]), (501, "Permission is hereby granted, free of\n\n\ncharge, to any person obtaining a copy")]
    found = licenses.find_licences(docs(spark, rows), model).collect()
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    text = dict(rows)
    whole = 0
    for k, (family, notice) in want.items():
        assert by[k] and {r["family"] for r in by[k]} == {family}, notice
        whole += any(text[k][r["start"] : r["end"]] == notice and r["paragraph"] == 2 and r["similarity"] == 1 for r in by[k])
    assert whole >= 0.6 * len(want) and 501 not in by


def test_filter_loses_nothing(spark, model):
    """The scan equals one that classifies every line: the trigram filter only saves work."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    rows += [(10**6 + k, "\n".join([PROSE[k], *[t for ts in licenses.TEMPLATES.values() for t in ts if len(licenses.tokens(t)) % 7 == k % 7], PROSE[k + 1]])) for k in range(14)]
    want = set()
    for d, t in rows:
        for number, line in enumerate((t or "").split("\n")):
            verdict = licenses.judged(model, line)
            if verdict:
                want.add((d, number, verdict[0], verdict[2]))
    got = {(r["doc_id"], r["paragraph"], r["family"], r["template"]) for r in licenses.find_licences(docs(spark, rows), model).collect()}
    assert len(want) > 100 and want <= got
    assert not {d for d, *_ in got} - {d for d, *_ in want}


def test_precision_and_recall_on_held_out_notices(spark, model):
    """Notices that are wrapped, marked as comments and edited by a word, among prose that isn't a notice."""
    fresh = random.Random(21)
    rows, want = [], {}
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            ws = t.split()
            if len(ws) < 8:
                continue
            for copy in range(3):
                if copy and len(licenses.tokens(t)) >= 28:
                    ws = t.split()
                    ws[fresh.randrange(len(ws))] = "something"
                lines = textwrap.wrap(" ".join(ws), fresh.choice((48, 64, 80)))
                mark = fresh.choice(("", "// ", " * ", "# ", "-- "))
                k = len(rows)
                rows.append((k, "\n".join([prose(fresh, 20), "", *[mark + x for x in lines], "", prose(fresh, 20)])))
                want[k] = family
    rows += [(5000 + k, "\n\n".join(prose(fresh, 25) for _ in range(4))) for k in range(300)]
    found = defaultdict(set)
    for r in licenses.find_licences(docs(spark, rows), model).collect():
        found[r["doc_id"]].add(r["family"])
    right = sum(family in found[k] for k, family in want.items())
    wrong = sum(len(fs - {want.get(k)}) for k, fs in found.items())
    assert right / len(want) >= 0.9 and right / (right + wrong) >= 0.95, (right, len(want), wrong)


FUNCTION_WORDS = (
    "the of and to in a is that it for was on are as with his they at be this have from or had by but not what all were we when your can said there use an each which she do how their if will up other about out "
    "many then them these so some her would make like him into time has look two more write go see number no way could people my than first been call who its now find long down day did get come made may part"
).split()


@pytest.mark.parametrize("around", [0, 50, 100, 200, 1000])
def test_notices_in_running_words(spark, model, around):
    """Each template anywhere in a line of the templates' own language, of up to 1,000 words on either side."""
    fresh, rows, want = random.Random(around), [], {}
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            if len(licenses.tokens(t)) < 3:
                continue
            k = len(rows)
            before, after = (" ".join(fresh.choice(FUNCTION_WORDS) for _ in range(around)) for _ in range(2))
            rows.append((k, f"é {before} {t} {after}\n" + " ".join(fresh.choice(FUNCTION_WORDS) for _ in range(300))))
            want[k] = (family, t)
    found = defaultdict(list)
    for r in licenses.find_licences(docs(spark, rows), model).collect():
        found[r["doc_id"]].append(r)
    right = [k for k, (family, _) in want.items() if family in {r["family"] for r in found[k]}]
    wrong = sum(r["family"] != want[k][0] for k, rs in found.items() for r in rs)
    assert len(right) >= 0.9 * len(want) and wrong <= 0.05 * len(right), (len(right), len(want), wrong)
    text = dict(rows)
    if around:
        near = [k for k in right if any(" ".join(licenses.tokens(want[k][1])) in " ".join(licenses.tokens(text[k][r["start"] : r["end"]])) and r["end"] - r["start"] <= len(want[k][1]) + 60 for r in found[k])]
        assert len(near) >= 0.9 * len(right)


def test_windows_equal_a_plain_search(spark, model):
    """Windows are where a template's three-word runs say, by other code: every start that enough runs vote for."""
    fresh = random.Random(4)
    every = [licenses.tokens(t) for ts in licenses.TEMPLATES.values() for t in ts]
    windows = licenses.Windows()
    for _ in range(20):
        ws = []
        for _ in range(4):
            own = list(fresh.choice(every))
            if len(own) > 8:
                own[fresh.randrange(len(own))] = "zzz"
            ws += [fresh.choice(FUNCTION_WORDS) for _ in range(fresh.randrange(12))] + own
        data = licenses.np.frombuffer(" ".join(ws).encode(), "u1")
        starts, ends, _ = licenses.words(data, licenses.np.array([0, len(data)]), licenses.APART)
        runs = licenses.sequence_hash(licenses.hashes(data, starts, ends), 3)
        got = {(a, z) for a, z, *_ in windows.found(runs, licenses.np.zeros(len(ws), int))}
        for t in every:
            votes = defaultdict(set)
            for i in range(len(ws) - 2):
                for o in range(len(t) - 2):
                    if ws[i : i + 3] == t[o : o + 3]:
                        votes[i - o].add(i)
            for s in votes:
                joined = set().union(*(v for x, v in votes.items() if x == s))
                if len(joined) >= licenses.VOTES * (len(t) - 2):
                    assert any(a <= max(0, s) and z >= min(len(ws), s + len(t)) for a, z in got)
