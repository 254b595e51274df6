"""Benchmark decontamination by one Aho-Corasick automaton over the test items' word windows.

Texts and items are normalised alike: A-Z lower-cased, cut into words. Every word that items have gets a number, written
in a few digits to base 32 whose alphabets differ by place; windows and texts become strings of such digits. The automaton
reads a text once and reports all windows that occur, whatever they overlap, and no node of it has more than 32 children.
Places of words lead hits back to the original text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, load, staged
from .tokens import FOLD, hashes, texts, words

#: Words of a window; an item with fewer is one window.
WINDOW = 10
#: (window, item) pairs of one automaton at most, some 100 MB of it. Larger benchmarks are dealt over several, one after the other.
MOST_PAIRS = 100_000

#: Digits of a word's number: each place has 32 of its own, and pairs of an automaton bound the places to four.
BASE, UNKNOWN = 32, 255

#: Bytes that are in no word: all of ASCII but digits and (lower-cased) letters.
PARTS = np.zeros(256, bool)
PARTS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def window_batches(size: int):
    """(win, item_id): windows of items, their words joined by spaces."""

    def of(batches):
        for batch in batches:
            ids, wins, of_item = batch.column("item_id").to_pylist(), [], []
            for first, _, data, bounds in texts(batch.column("text")):
                raw = FOLD[data].tobytes()
                starts, ends, at = words(np.frombuffer(raw, np.uint8), bounds, PARTS)
                said = [raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
                for k, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    own = {b" ".join(said[i : min(i + size, z)]) for i in range(a, max(z - size, a) + 1)} if z > a else set()
                    wins += own
                    of_item += [ids[first + k]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()).cast(pa.string()), pa.array(of_item, pa.string())], ["win", "item_id"])

    return of


class Automaton:
    """Windows of words as strings of digits, as many for each word."""

    def __init__(self, pairs: list[tuple[str, str | None]]) -> None:
        import ahocorasick

        items: dict[bytes, set[str | None]] = {}
        for win, item in pairs:
            items.setdefault(win.encode(), set()).add(item)
        self.windows = list(items)
        self.items = [sorted(x for x in items[w] if x is not None) for w in self.windows]
        self.sizes = [w.count(b" ") + 1 for w in self.windows]
        known = sorted({word for w in self.windows for word in w.split(b" ")})
        raw, ends = np.frombuffer(b"".join(known), np.uint8), np.cumsum([len(w) for w in known], dtype=np.int64)
        h = hashes(raw, ends - [len(w) for w in known], ends) if known else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.width = 1
        while BASE**self.width < len(known):
            self.width += 1
        place = np.arange(self.width)
        digits = (np.arange(len(known))[:, None] // BASE**place % BASE + BASE * place).astype(np.uint8)
        self.known = h[order]
        self.digits = np.concatenate([digits[order], np.full((1, self.width), UNKNOWN, np.uint8)])
        digits_of = {w: d.tobytes().decode("latin-1") for w, d in zip(known, digits)}
        self.trie = ahocorasick.Automaton()
        for k, w in enumerate(self.windows):
            self.trie.add_word("".join(digits_of[x] for x in w.split(b" ")), k)
        if known:
            self.trie.make_automaton()

    def read(self, h: np.ndarray) -> np.ndarray:
        """The digits of words by their hashes; words that no item has are ``UNKNOWN``."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return self.digits[np.where(self.known[at] == h, at, -1)] if len(self.known) else self.digits[np.full(len(h), -1)]

    def hits(self, digits: np.ndarray, said) -> list[tuple[int, int, int]]:
        """(first word, last word, window) of every occurrence; ``said`` gives the text's bytes from a word to another."""
        if not self.windows:
            return []
        out = []
        for at, k in self.trie.iter(digits.tobytes().decode("latin-1")):
            last = at // self.width
            first = last - self.sizes[k] + 1
            if said(first, last) == self.windows[k]:  # digits go by hashes
                out.append((first, last, k))
        return out


_made: dict[str, Automaton] = {}


def automaton(pairs) -> Automaton:
    """One automaton for each worker process, of the shard that it last worked on."""
    if pairs.id not in _made:
        _made.clear()
        _made[pairs.id] = Automaton(pairs.load())
    return _made[pairs.id]


class Shard:
    """The pairs of one automaton as a broadcast, built once in each worker."""

    def __init__(self, spark: SparkSession, number: int, pairs: pa.Table) -> None:
        columns = list(zip(pairs.column("win").to_pylist(), pairs.column("item_id").to_pylist()))
        self.sent, self.id = spark.sparkContext.broadcast(columns), f"{uuid.uuid4().hex}-{number}"

    def load(self) -> list[tuple[str, str | None]]:
        return self.sent.value


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
STATE = "runs array<struct<first:int,last:int>>, item_ids array<string>"
FOUND = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


def joined_runs(marks: np.ndarray) -> np.ndarray:
    """(first, last) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return np.stack([edges[::2], edges[1::2] - 1], axis=1)


def scan_batches(shard: Shard, last: bool):
    """Adds a shard's hits to those of the shards before; the last one counts words and finds places in the text."""

    def of(batches):
        found = automaton(shard)
        for batch in batches:
            before = batch.column("runs").to_pylist() if "runs" in batch.schema.names else None
            items_before = batch.column("item_ids").to_pylist() if before else None
            n_words, n_hit, items, runs, spans = [], [], [], [], []
            for first, _, data, bounds in texts(batch.column("text")):
                data = FOLD[data]
                starts, ends, at = words(data, bounds, PARTS)
                digits = found.read(hashes(data, starts, ends))
                for k, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    said = lambda i, j, a=a: b" ".join(data[starts[a + w] : ends[a + w]].tobytes() for w in range(i, j + 1))  # noqa: E731, B023
                    hits = found.hits(digits[a:z], said)
                    own, earlier = (set(items_before[first + k]), before[first + k]) if before else (set(), [])
                    hit = np.zeros((0, 2), np.int64)
                    if hits or earlier:
                        covered = np.zeros(z - a + 1, np.int32)
                        for i, j, w in hits:
                            covered[i] += 1
                            covered[j + 1] -= 1
                            own.update(found.items[w])
                        marks = np.cumsum(covered[:-1]) > 0
                        for run in earlier:
                            marks[run["first"] : run["last"] + 1] = True
                        hit = joined_runs(marks)
                    n_words.append(z - a)
                    n_hit.append(int((hit[:, 1] - hit[:, 0] + 1).sum()))
                    items.append(sorted(own))
                    runs.append([{"first": i, "last": j} for i, j in hit.tolist()])
                    spans.append([])
                    if last and len(hit):
                        points = np.cumsum((data[bounds[k] : bounds[k + 1]] & 0xC0) != 0x80)  # code points up to each byte
                        place = lambda byte, k=k, p=points: int(p[byte - bounds[k] - 1]) if byte > bounds[k] else 0  # noqa: E731, B023
                        spans[-1] = [{"start": place(starts[a + i]), "end": place(ends[a + j])} for i, j in hit.tolist()]
            if last:
                columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "item_ids", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(runs, RUNS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "runs", "item_ids"])

    return of


def find_leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids, spans.

    A window is ``size`` consecutive words of an item; an item of fewer words is one window, one of none has none. A
    document's word is hit if it lies in an occurrence of a window. ``item_ids`` are the items with occurring
    windows, as strings, sorted and each once; spans are the runs of hit words in the original text (code points, end exclusive).

    A null text has no words. A null doc_id is carried along; rows that repeat an id are searched each on its own. A null
    item_id's windows hit, but it can't be named; items that repeat an id count as one. Other columns are ignored.
    No documents, no rows; without items nothing is hit.

    Up to ``most_pairs`` (window, item) pairs, texts are scanned once, by one automaton. A larger benchmark is dealt by hash
    over several automata, and texts and hits are staged between their scans.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    pairs = staged(items.mapInArrow(window_batches(size), "win string, item_id string").distinct(), "leak-windows")
    shards = max(1, -(-pairs.count() // most_pairs))
    dealt = F.pmod(F.xxhash64("win", "item_id"), F.lit(shards))
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for number in range(shards):
        shard = Shard(spark, number, pairs.where(dealt == number).toArrow())  # most_pairs rows or so
        if number == shards - 1:
            return left.mapInArrow(scan_batches(shard, last=True), FOUND)
        scanned = staged(left.mapInArrow(scan_batches(shard, last=False), f"doc_id long, text string, {STATE}"), "leak-scanned")
        if number:
            discard(left)
        left = scanned
    raise AssertionError("there is always a last shard")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i:i+9], ' '))) AS win
         FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM wins),
grams AS (SELECT n, size, i, array_to_string(w[i:i+size-1], ' ') AS win
          FROM (SELECT n, w, size, unnest(generate_series(1, CAST(len(w) - size + 1 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT n, i, size, item_id FROM grams JOIN wins USING (size, win)),
marked AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT n, i, size FROM hits)) GROUP BY n),
named AS (SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT n, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (n) LEFT JOIN named USING (n)
"""

QUERIES = {"op12_decontamination": op12_decontamination}
ORACLE_SQL = {"op12_decontamination": ORACLE}
