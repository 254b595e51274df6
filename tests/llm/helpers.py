"""Small documents with the cases that every operator has to take."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Copy string, `Digest` string, kinds string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def docs(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, source]); extra columns clash with the operators' helper names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, schema)


def prose(rng, n, words=2000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))
