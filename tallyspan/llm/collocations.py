"""Phrase collocations by multikey quicksort of suffixes.

A suffix is the words from a place in a piece of text on, five at most. Suffixes are routed by their leading words, so that
all that begin alike meet in one task, and sorted there by multikey three-way quicksort: the partition that equals the
pivot is a phrase, its size is the phrase's count, and what is infrequent is abandoned. Before that, counts in hashed
buckets show which words and pairs can't be frequent; suffixes end before them, and equal ones are added up where they lie.
Leading words that too many suffixes share are counted from the suffixes' sums, and routed by another word.

Words are 64-bit hashes of language and word, under a seed that is checked to tell all words apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, load, staged
from .tokens import FOLD, M1, M2, hashes, mixed, texts, words

#: Words of a phrase at most, and its least count.
LONGEST, SUPPORT = 5, 100
#: A candidate goes if a longer one around it has this share of its count, in per cent.
COVER = 100
TOP = 2000
#: log2 of the buckets: so many that a bucket holds some 16 words' places, within these bounds (a bit each is sent to the tasks).
FEWEST, MOST = 16, 27
#: Buckets of a row of counts.
BLOCK = 1 << 14
#: Suffixes that a task gathers before it adds them up and hands them on.
GATHERED = 1 << 19
#: Leading words are routed on by another word where more than this share of all suffixes has them; the least and the most that it comes to.
HOT_SHARE, HOT_LEAST, HOT_MOST = 2e-4, 200, 5_000_000
UNDETERMINED = "und"

ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
PARTS = ENDS_PIECE.copy()
PARTS[[0x20, 0x09]] = True

NAMES = [f"w{k}" for k in range(1, LONGEST + 1)]
#: What a suffix is routed by: two words, and as many more as its leading words' size asks for.
LEAD = ["w1", "w2", "routed", *(f"lead{k}" for k in range(3, LONGEST + 1))]
SUFFIX = ", ".join(f"{n} long" for n in NAMES) + ", n long"


# --- words -------------------------------------------------------------------------------------


def stirred(seed: int) -> np.ndarray:
    """A permutation of bytes that makes another function of the words' hash."""
    return np.random.default_rng(seed).permutation(256).astype(np.uint8)


def hashed_words(batch: pa.RecordBatch, seed: int):
    """For slices of a batch: first row, bytes, starts, ends, bounds of each text's words, their hashes (never 0), and the
    number of each word's piece."""
    langs = batch.column("lang").to_pylist()
    distinct = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
    raw = [x.encode() for x in distinct]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    stir = stirred(seed)
    of_lang = mixed(hashes(stir[np.frombuffer(b"".join(raw), np.uint8)], ends - [len(x) for x in raw], ends) * M2) if raw else np.zeros(0, np.uint64)
    number = np.array([distinct[x] for x in langs], np.int64)
    for first, to, data, bounds in texts(batch.column("text")):
        data = FOLD[data]
        starts, stops, at = words(data, bounds, PARTS)
        row = np.repeat(np.arange(first, to), np.diff(at))
        h = np.maximum(mixed((hashes(stir[data], starts, stops) ^ of_lang[number[row]]) * M1), np.uint64(1))
        piece = np.cumsum(ENDS_PIECE[data])[starts] + row if len(starts) else np.zeros(0, np.int64)
        yield first, data, starts, stops, at, h, piece


def word_batches(seed: int):
    """(lang, word, h, n): the distinct words of each slice and language."""

    def of(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, data, starts, stops, at, h, _ in hashed_words(batch, seed):
                distinct, where, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                other = hashes(stirred(-1 - seed & 0xFFFF)[data], starts, stops)
                if len(apart := np.flatnonzero(other != other[where][inverse])):  # other words of the same hash: rows of their own
                    distinct, where = np.append(distinct, h[apart]), np.append(where, apart)
                    n = np.append(n - np.bincount(inverse[apart], minlength=len(n)), np.ones(len(apart), np.int64))
                row = first + np.searchsorted(at, where, "right") - 1
                size = (stops - starts)[where]
                bounds = np.concatenate([[0], np.cumsum(size)])
                byte = np.arange(bounds[-1]) + np.repeat(starts[where] - bounds[:-1], size)
                said = pa.Array.from_buffers(pa.large_string(), len(where), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[byte]))])
                yield pa.RecordBatch.from_arrays([pa.array(langs[row], pa.string()), said.cast(pa.string()), pa.array(distinct.view(np.int64)), pa.array(n)], ["lang", "word", "h", "n"])

    return of


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, h, n) of all words, and the seed under which no two have the same hash."""
    for seed in range(1, 9):
        found = docs.mapInArrow(word_batches(seed), "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
        counted = staged(found, "phrase-words")
        if counted.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            return counted, seed
        discard(counted)
    raise ValueError("no seed tells all words apart")


# --- buckets -----------------------------------------------------------------------------------


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def pair_hash(h: np.ndarray) -> np.ndarray:
    return mixed(h[:-1] * M1 + h[1:])


class Marks:
    """A bit for each bucket, by block: set where a bucket's count may be frequent."""

    def __init__(self, rows: list, bits: int) -> None:
        self.bits, self.blocks = bits, {r["block"]: r["marks"] for r in rows}

    def load(self) -> np.ndarray:
        every = np.zeros(1 << self.bits >> 3, np.uint8)
        for block, marks in self.blocks.items():
            part = np.frombuffer(bytes(marks), np.uint8)
            every[block * (BLOCK >> 3) : block * (BLOCK >> 3) + len(part)] = part
        return every


_made: dict[str, tuple[np.ndarray, ...]] = {}


def loaded(sent) -> tuple[np.ndarray, ...]:
    """The marks of a broadcast, unpacked into bytes of bits once in each worker."""
    if sent.id not in _made:
        _made.clear()
        _made[sent.id] = tuple(m.load() for m in sent.value.value)
    return _made[sent.id]


class Sent:
    def __init__(self, spark: SparkSession, *marks: Marks) -> None:
        self.value, self.id, self.bits = spark.sparkContext.broadcast(marks), uuid.uuid4().hex, [m.bits for m in marks]


def marked(marks: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (marks[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1


def word_marks(frequent: DataFrame, bits: int) -> Marks:
    """The buckets of frequent words."""

    def of(batches):
        for batch in batches:
            at = np.unique(bucket(batch.column("h").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array((at % BLOCK).astype(np.int32))], ["block", "place"])

    def packed(table: pa.Table) -> pa.Table:
        bit = np.zeros(BLOCK, bool)
        bit[table.column("place").to_numpy()] = True
        return pa.table({"block": table.column("block")[:1], "marks": pa.array([np.packbits(bit).tobytes()], pa.binary())})

    places = frequent.select("h").mapInArrow(of, "block long, place int").distinct()
    return Marks(places.groupBy("block").applyInArrow(packed, "block long, marks binary").collect(), bits)  # 2^MOST bits at most


def frequent_pairs(batch: pa.RecordBatch, seed: int, sent: Sent):
    """For slices: hashes of words, and where a word and the next are frequent and in one piece; hashes of those pairs."""
    frequent = loaded(sent)[0]
    for *_, h, piece in hashed_words(batch, seed):
        good = marked(frequent, bucket(h, sent.bits[0]))
        yield h, good[:-1] & good[1:] & (piece[:-1] == piece[1:]), pair_hash(h)


def pair_marks(docs: DataFrame, seed: int, sent: Sent, bits: int, support: int) -> Marks:
    """The buckets whose pairs of frequent words may be frequent. Counts are held up to ``support``: more isn't asked for."""
    kind = np.uint8 if support < 256 else np.uint32

    def of(batches):
        held = np.zeros(1 << bits, kind)
        for batch in batches:
            for _, joined, pairs in frequent_pairs(batch, seed, sent):
                at, n = np.unique(bucket(pairs[joined], bits), return_counts=True)
                held[at] = np.minimum(held[at].astype(np.int64) + n, support)
        rows = held.reshape(-1, BLOCK)
        used = np.flatnonzero(rows.any(axis=1))
        for at in range(0, len(used), 64):
            some = used[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[k].tobytes() for k in some], pa.binary())], ["block", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(BLOCK, np.int64)
        for batch in batches:  # a row for each task, taken as they come
            block = batch.column("block")[:1]
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, kind)
        if block is not None:
            yield pa.RecordBatch.from_arrays([block, pa.array([np.packbits(total >= support).tobytes()], pa.binary())], ["block", "marks"])

    counts = docs.mapInArrow(of, "block long, counts binary")
    return Marks(counts.groupBy("block").applyInArrow(summed, "block long, marks binary").collect(), bits)  # 2^MOST bits at most


# --- suffixes ----------------------------------------------------------------------------------


def added_up(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their counts."""
    if not len(n):
        return w, n
    order = np.lexsort(w.T[::-1])
    w, n = w[order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = (w[1:] != w[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return w[first], np.add.reduceat(n, first)


def suffix_rows(w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(w[:, k]).view(np.int64)) for k in range(LONGEST)), pa.array(n)], [*NAMES, "n"])


def suffix_batches(seed: int, sent: Sent):
    """Suffixes whose first pair may be frequent, each up to a pair that can't be; 0 is no word. Equal ones are added up."""

    def of(batches):
        may = None
        parts, size = [], 0

        def rows():
            w = np.concatenate(parts) if parts else np.zeros((0, LONGEST), np.uint64)
            return suffix_rows(*added_up(w, np.ones(len(w), np.int64)))

        for batch in batches:
            may = loaded(sent)[1]
            for h, joined, pairs in frequent_pairs(batch, seed, sent):
                goes_on = joined & marked(may, bucket(pairs, sent.bits[1]))
                at = np.flatnonzero(goes_on)
                w = np.zeros((len(at), LONGEST), np.uint64)
                w[:, 0], w[:, 1] = h[at], h[at + 1]
                alive = np.ones(len(at), bool)
                for k in range(2, LONGEST):
                    alive &= np.append(goes_on, np.zeros(LONGEST, bool))[at + k - 1]
                    w[alive, k] = h[at[alive] + k]
                parts.append(w)
                size += len(w)
                if size > GATHERED:
                    yield rows()
                    parts, size = [], 0
        yield rows()

    return of


def multikey_quicksort(w: np.ndarray, n: np.ndarray, support: int, least_depth: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, size, count): the phrases of ``support`` occurrences or more, as the first ``size`` words of a row.

    Three-way quicksort by one word after the other, all partitions of a round at once. The partition that equals its
    pivot is a phrase whose count is the sum over its rows, and goes on with the next word; partitions whose sums are below
    ``support`` are abandoned. 0, which is no word, goes no further.
    """
    pointer, found = np.arange(len(n)), []
    starts, depth = np.zeros(1 if len(n) else 0, np.int64), np.zeros(1 if len(n) else 0, np.int64)
    while len(pointer):
        sizes = np.diff(np.append(starts, len(pointer)))
        part = np.repeat(np.arange(len(starts)), sizes)
        x = w[pointer, depth[part]]
        a, b, c = x[starts], x[starts + sizes // 2], x[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))  # the median of three
        side = (x >= pivot[part]).astype(np.int64) + (x > pivot[part])
        group = part * 3 + side
        count = np.bincount(group, minlength=3 * len(starts))
        weight = np.zeros(3 * len(starts), np.int64)
        np.add.at(weight, group, n[pointer])
        begin = np.cumsum(count) - count
        place = np.empty(len(pointer), np.int64)
        for s in range(3):
            mine = side == s
            rank = np.cumsum(mine) - mine
            rank = rank - rank[starts][part]
            place[mine] = (begin[group] + rank)[mine]
        sorted_pointer = np.empty_like(pointer)
        sorted_pointer[place] = pointer

        equal = np.arange(len(starts)) * 3 + 1
        new_depth = np.repeat(depth, 3)
        new_depth[equal] += 1
        word = np.ones(3 * len(starts), bool)
        word[equal] = pivot != 0
        alive = (count > 0) & (weight >= support) & word
        reported = equal[alive[equal] & (new_depth[equal] >= least_depth)]
        found.append((sorted_pointer[begin[reported]], new_depth[reported], weight[reported]))
        alive &= new_depth < w.shape[1]
        keep = np.repeat(alive, count)
        pointer = sorted_pointer[keep]
        starts, depth = (np.cumsum(count * alive) - count * alive)[alive], new_depth[alive]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def phrase_table(table: pa.Table, support: int, least_depth: int) -> pa.RecordBatch:
    w = np.stack([table.column(c).to_numpy().view(np.uint64) for c in NAMES], axis=1)
    row, size, count = multikey_quicksort(w, table.column("n").to_numpy(), support, least_depth)
    return suffix_rows(np.where(np.arange(LONGEST) < size[:, None], w[row], np.uint64(0)), count)


def sort_batches(support: int):
    """Phrases of suffixes that come ordered by what they are routed by, so many at a time, with all that share it."""

    def of(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) > GATHERED:
                table = pa.Table.from_batches(waiting)
                lead = np.stack([table.column(c).to_numpy() for c in LEAD], axis=1)
                end = np.flatnonzero((lead[1:] != lead[:-1]).any(axis=1))  # the last group may go on
                if len(end):
                    yield from sorted_phrases(table.slice(0, end[-1] + 1), support)
                    waiting = table.slice(end[-1] + 1).to_batches()
        if waiting:
            yield from sorted_phrases(pa.Table.from_batches(waiting), support)

    return of


def sorted_phrases(table: pa.Table, support: int):
    routed = table.column("routed").to_numpy()
    for by in np.unique(routed):
        yield phrase_table(table.filter(pa.array(routed == by)), support, int(by))


def count_phrases(suffixes: DataFrame, support: int, hot_least: int) -> DataFrame:
    """(w1..w5, n): all phrases of two words or more and ``support`` occurrences or more, of staged suffixes."""
    spark, total = suffixes.sparkSession, suffixes.count()
    hot_rows = min(max(hot_least, int(total * HOT_SHARE)), HOT_MOST)
    routed = suffixes.withColumn("routed", F.lit(2))
    counted = []
    for depth in range(2, LONGEST):  # leading words that more than hot_rows suffixes share: total / hot_rows at most
        lead = NAMES[:depth]
        of_depth = routed.where((F.col("routed") == depth) & (F.col(NAMES[depth - 1]) != 0))
        hot = of_depth.groupBy(*lead).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).where(F.col("rows") > hot_rows)
        hot = staged(hot.select(*lead, "n"), "phrase-hot")
        if hot.isEmpty():
            break
        zeros = [F.lit(0).cast("long").alias(c) for c in NAMES[depth:]]
        counted.append(hot.where(F.col("n") >= support).select(*lead, *zeros, "n"))
        again = F.broadcast(hot.select(*[F.col(c).alias(f"hot_{c}") for c in lead]))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"hot_{c}") for c in lead]) & (F.col("routed") == depth)
        routed = routed.join(again, same, "left").withColumn("routed", F.when(F.col("hot_w1").isNotNull(), F.lit(depth + 1)).otherwise(F.col("routed"))).select(*NAMES, "n", "routed")
    # a suffix that is routed by more words than it has is counted with its hot leading words, and is no longer phrase
    needed = reduce(lambda a, b: a | b, [(F.col("routed") == k) & (F.col(NAMES[k - 1]) != 0) for k in range(2, LONGEST + 1)])
    lead = {f"lead{k}": F.when(F.col("routed") >= k, F.col(NAMES[k - 1])).otherwise(F.lit(0)) for k in range(3, LONGEST + 1)}
    dealt = routed.where(needed).withColumns(lead).repartition(*LEAD).sortWithinPartitions(*LEAD)
    counted.append(dealt.mapInArrow(sort_batches(support), SUFFIX))
    return reduce(DataFrame.unionByName, counted)


# --- scores ------------------------------------------------------------------------------------


def key(values: list[Column]) -> list[Column]:
    """Columns of the words, filled up with zeros."""
    return [*values, *[F.lit(0).cast("long")] * (LONGEST - len(values))]


def part(first: int, size: int) -> Column:
    """The words from ``first`` on (from 0) as a struct of five."""
    return F.struct(*[c.alias(n) for c, n in zip(key([F.col(NAMES[k]) for k in range(first, first + size)]), NAMES)])


def scored(phrases: DataFrame, frequent: DataFrame, totals: DataFrame, cover: int) -> DataFrame:
    """(w1..w5, size, lang, a, l, r, n, score) of the phrases that no longer one covers."""
    size = reduce(lambda x, y: x + y, [(F.col(c) != 0).cast("int") for c in NAMES])
    phrases = staged(phrases.select(*NAMES, F.col("n").alias("a"), size.alias("size")), "phrases")
    single = frequent.select(F.struct(*[c.alias(n) for c, n in zip(key([F.col("h")]), NAMES)]).alias("of"), F.col("n").alias("f"))
    counts = single.unionByName(phrases.select(part(0, LONGEST).alias("of"), F.col("a").alias("f")))

    def within(longer: int) -> Column:
        return F.array(part(0, longer - 1), part(1, longer - 1))

    inside = F.coalesce(*[F.when(F.col("size") == m, within(m)) for m in range(3, LONGEST + 1)])
    # a phrase around another by one word has the largest count of all around it
    around = phrases.where("size > 2").select(F.explode(inside).alias("of"), "a").groupBy("of").agg(F.max("a").alias("around"))
    left = phrases.withColumn("of", part(0, LONGEST)).join(around, "of", "left").where(F.col("around").isNull() | (100 * F.col("around") < cover * F.col("a"))).drop("of", "around")

    cut = lambda m, k: F.struct(F.lit(k).alias("k"), part(0, k).alias("left"), part(k, m - k).alias("right"))
    cuts = F.coalesce(*[F.when(F.col("size") == m, F.array(*[cut(m, k) for k in range(1, m)])) for m in range(2, LONGEST + 1)])
    each = left.withColumn("cut", F.explode(cuts)).select(*NAMES, "size", "a", "cut.*")
    for side in ("left", "right"):
        each = each.join(counts.select(F.col("of").alias(side), F.col("f").alias(side[0])), side).drop(side)
    of_lang = frequent.select(F.col("h").alias("w1"), "lang").join(F.broadcast(totals), "lang")  # a row for each language
    each = each.join(of_lang, "w1")
    # counts have 14 digits at most, so products have 32 and quotients are exact
    number = lambda c: F.col(c).cast("decimal(14,0)")
    each = each.withColumn("top", F.lit(1000).cast("decimal(4,0)") * (number("a") * number("n"))).withColumn("below", number("l") * number("r"))
    each = each.withColumn("score", F.expr("CAST(top AS DECIMAL(38,0)) div CAST(below AS DECIMAL(38,0))"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("lowest")
    best = each.groupBy(*NAMES, "size", "lang", "a", "n").agg(lowest)
    return best.select(*NAMES, "size", "lang", "a", "lowest.l", "lowest.r", "n", "lowest.score")


def with_text(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` with their phrases, words joined by spaces."""
    said = rows.withColumn("id", part(0, LONGEST)).select("*", F.posexplode(F.array(*NAMES)).alias("at", "h")).where("h <> 0")
    named = said.join(frequent.select("h", "word"), "h").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return rows.withColumn("id", part(0, LONGEST)).join(named, "id").drop("id", *NAMES)


def phrases(docs: DataFrame, support: int = SUPPORT, cover: int = COVER, hot_least: int = HOT_LEAST) -> DataFrame:
    """Phrases that occur ``support`` times or more in a language: lang, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at spaces and tabs. A
    phrase is 2 to 5 words of a piece; ``a`` counts its occurrences, overlaps included, ``n`` all words of the language. A phrase cut in
    two after its first words scores floor(1000 a n / (l r)), l and r being the counts of the parts; its lowest-scoring cut
    counts, the first of equals. Phrases inside a longer one of ``cover`` per cent of their count or more go.

    Null texts are empty; a null language is ``und``; rows that repeat count each; other columns are ignored; no phrases, no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit(UNDETERMINED)).alias("lang"))
    counted, seed = count_words(docs)
    totals = staged(counted.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    frequent = staged(counted.where(F.col("n") >= support), "phrase-frequent")
    discard(counted)
    every = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST, max(FEWEST, int(every // 16).bit_length()))
    of_words = word_marks(frequent, bits)
    of_pairs = pair_marks(docs, seed, Sent(spark, of_words), bits, support)
    suffixes = staged(docs.mapInArrow(suffix_batches(seed, Sent(spark, of_words, of_pairs)), SUFFIX), "phrase-suffixes")
    found = staged(scored(count_phrases(suffixes, support, hot_least), frequent, totals, cover), "phrase-scores")
    discard(suffixes)
    return with_text(found, frequent).select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, support: int = SUPPORT, cover: int = COVER, top: int = TOP, hot_least: int = HOT_LEAST) -> DataFrame:
    """Each language's first ``top`` phrases with their rank: by score, then a, both descending, then phrase by its bytes."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = phrases(docs, support, cover, hot_least)
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, size, w[i:i+size-1] AS g FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
          FROM pieces, (VALUES (1), (2), (3), (4), (5)) s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.g, c.size, c.f AS a, k, x.f AS l, y.f AS r, 1000 * CAST(c.f AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS score
         FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM f WHERE size > 1) c
         JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k+1:c.size] JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, g[i:i+m-1] AS g, max(f) AS f FROM (SELECT lang, g, f, size, m, unnest(generate_series(1, size - m + 1)) AS i FROM f, (VALUES (2), (3), (4)) s(m) WHERE size > m) GROUP BY ALL),
left_over AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR 100 * o.f < 100 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLE_SQL = {"op13_collocations": ORACLE}
