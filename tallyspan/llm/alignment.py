"""Alignment of two tokenizers' tokens by the bytes that they cover.

Character offsets of the byte-level tokenizer and the spans of sentencepiece's immutable proto are coarse cuts. Where
several tokens share a character (a multibyte sign cut apart, byte-fallback pieces), decoded bytes refine them. Byte
offsets where tokens of both end cut a text's tokens into groups. How often an id pair is linked in all texts is counted in
two levels; pairs that are frequent go to the tasks as a table of bounded size, the others meet by a join.

Neither tokenizer has a token that holds something else before white space, so texts are worked on by chunks of white
space and what follows it, and workers remember the chunks that they have seen.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, load, staged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: A worker remembers so many chunks, then as many newer ones beside them, then lets go of those that it hasn't met since.
#: A longer chunk isn't remembered.
REMEMBERED, LONGEST = 400_000, 64
#: Characters of new chunks that go through the tokenizers at a time.
TOGETHER = 1 << 15
#: Characters of texts whose chunks are looked up at a time; a longer text goes alone.
TEXTS = 1 << 19
#: Id pairs that are sent to all tasks at most (17 bytes each), the most frequent ones.
SENT = 1 << 20
#: Distinct pairs that a task gathers before it hands them on.
GATHERED = 1 << 19
#: A pair as one number: the first tokenizer's id above, the second's below.
SHIFT = 20

#: White space as the byte-level tokenizer's pre-tokenizer has it. A carriage return can belong to the token before it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(rf"[{SPACES}]*[^{SPACES}]+(?:\r[{SPACES}]*[^{SPACES}]*)*|[{SPACES}]+")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_places(text: str) -> np.ndarray:
    """The byte at which each character starts, and the end."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])


def refined(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse cuts, refined by decoded sizes where the cuts don't follow on each other."""
    n = len(ends)
    if not n:
        return ends
    clean = np.empty(n, bool)  # the token after it begins where it ends, and both hold whole characters
    clean[-1] = True
    clean[:-1] = (ends[:-1] == starts[1:]) & (ends[:-1] > starts[:-1])
    total = np.cumsum(sizes)
    known = np.flatnonzero(clean)
    before = np.searchsorted(known, np.arange(n)) - 1  # the last clean token before each
    at = np.where(before >= 0, known[np.maximum(before, 0)], -1)
    from_there = total - np.where(at >= 0, total[np.maximum(at, 0)], 0)
    return np.where(clean, ends, np.where(at >= 0, ends[np.maximum(at, 0)], 0) + from_there)


@dataclass(slots=True, eq=False)
class Aligned:
    """A text's or a chunk's tokens: counts, the groups as text, and the linked pair that ends each group."""

    n_a: int
    n_b: int
    groups: str
    pairs: bytes  # little-endian 64-bit numbers


class Aligner:
    """Tokens of both tokenizers for texts, one for each worker process."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        sign = byte_of_sign()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # what chunks rest on: no token of either runs from something else into white space other than a carriage return
        across = re.compile(rf"[^{SPACES}][{SPACES.replace(chr(13), '')}]")
        tokens = [x.decode("utf-8", "replace") for x in (*self.bytes_a, *self.bytes_b)]
        self.by_chunks = not any(across.search(t) for t in tokens)
        self.known: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def tokens_a(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and byte ends of the first tokenizer; None if the bytes aren't the text's."""
        made = self.a.encode(text, add_special_tokens=False)
        ids = np.array(made.ids, np.int64)
        if b"".join([self.bytes_a[i] for i in made.ids]) != text.encode():
            return None
        cuts = byte_places(text)[np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)]
        return ids, refined(cuts[:, 0], cuts[:, 1], self.sizes_a[ids])

    def tokens_b(self, text: str, whole: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """The same of the second, which puts a space before what it is given. A chunk that begins with other white
        space (not ``whole``) has that space as a token of its own, which goes."""
        spaced = text.startswith(" ")
        proto = self.b.encode(text[1:] if spaced else text, return_type="proto")
        pieces, shift = list(proto.pieces), 1
        if not spaced:
            if whole or not pieces or self.bytes_b[pieces[0].id] != b" ":
                return None
            pieces, shift = pieces[1:], 0
        ids, starts, ends = [p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]
        if b"".join([self.bytes_b[i] for i in ids]) != text.encode():
            return None
        numbers, starts, ends = np.array(ids, np.int64), np.array(starts, np.int64) + shift, np.array(ends, np.int64) + shift
        starts[:1] = 0
        return numbers, refined(starts, ends, self.sizes_b[numbers])

    def align(self, text: str, whole: bool = True) -> Aligned | None:
        a, b = self.tokens_a(text), self.tokens_b(text, whole)
        return None if a is None or b is None else aligned(*a, *b)

    def learn(self, chunks: list[str]) -> None:
        """Remember chunks. Most go through the tokenizers in a row, which is cut at their bounds; the others each alone."""
        plain = [c for c in chunks if c[0] in SPACES and c[0] != "\r" and c[-1] not in SPACES and "▁" not in c]
        while plain:
            sizes = np.cumsum([len(c) for c in plain[:8192]])
            n = max(1, int(np.searchsorted(sizes, TOGETHER)))
            self.known.update(self.together(plain[:n]))
            plain = plain[n:]
        for chunk in chunks:
            if chunk not in self.known:
                self.known[chunk] = self.align(chunk, whole=False)

    def together(self, chunks: list[str]) -> dict[str, Aligned]:
        """The chunks of a row that both tokenizers cut at its bounds."""
        row = "".join([" a", *chunks])
        a, b = self.tokens_a(row), self.tokens_b(row)
        if a is None or b is None:
            return {}
        (ids_a, ends_a), (ids_b, ends_b) = a, b
        at_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True))
        ends = ends_a[at_a]
        at_b = np.searchsorted(ends_b, ends)
        pairs = (ids_a[at_a] << SHIFT | ids_b[at_b]).astype("<i8").tobytes()
        groups = group_names(ids_a, ids_b, at_a, at_b)
        bounds = np.cumsum([2, *[len(c.encode()) for c in chunks]])
        last = np.minimum(np.searchsorted(ends, bounds), len(ends) - 1)  # the group that ends at each bound
        cut, to_a, to_b, last = (ends[last] == bounds).tolist(), at_a[last].tolist(), at_b[last].tolist(), last.tolist()
        return {
            c: Aligned(to_a[k + 1] - to_a[k], to_b[k + 1] - to_b[k], ";".join(groups[last[k] + 1 : last[k + 1] + 1]), pairs[8 * (last[k] + 1) : 8 * (last[k + 1] + 1)])
            for k, c in enumerate(chunks)
            if cut[k] and cut[k + 1]
        }

    def parts(self, texts: list[str | None]) -> list[list[Aligned]]:
        """Each text's chunks, or the text as one; none if it has no tokens. New chunks of all are learnt at once."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, split = self.known, [CHUNK.findall(" " + t) if t and self.by_chunks else [] for t in texts]
        new = {c for chunks in split for c in chunks if c not in known and len(c) <= LONGEST}
        met = [c for c in new if c in self.older]
        known.update(zip(met, map(self.older.__getitem__, met)))
        if len(new) > len(met):
            self.learn([c for c in new if c not in known])
        out = []
        for text, chunks in zip(texts, split):
            try:
                found = [known[c] for c in chunks]
            except KeyError:  # long ones
                found = [known[c] if c in known else self.align(c, whole=False) for c in chunks]
            if text and (not chunks or None in found):
                found = [x] if (x := self.align(" " + text)) else []
            out.append(found)
        return out

    def each(self, column: pa.Array):
        """``parts`` of a column, some texts at a time."""
        waiting, size = [], 0
        for text in column:
            waiting.append(text.as_py())
            size += len(waiting[-1] or "")
            if size > TEXTS:
                yield from self.parts(waiting)
                waiting, size = [], 0
        yield from self.parts(waiting)


def group_names(ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[str]:
    """Groups as text, of tokens up to and with those at ``at_a`` and ``at_b``."""
    names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
    groups, i, j = [], 0, 0
    for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
        a = names_a[i] if x == i + 1 else ",".join(names_a[i:x])
        b = names_b[j] if y == j + 1 else ",".join(names_b[j:y])
        groups.append(f"{a}|{b}")
        i, j = x, y
    return groups


def aligned(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Groups between the byte offsets where tokens of both end, and the pair of tokens that end there."""
    at_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True))
    at_b = np.searchsorted(ends_b, ends_a[at_a])
    return Aligned(len(ids_a), len(ids_b), ";".join(group_names(ids_a, ids_b, at_a, at_b)), (ids_a[at_a] << SHIFT | ids_b[at_b]).astype("<i8").tobytes())


_made: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _made:
        _made[paths] = Aligner(*paths)
    return _made[paths]


ROW = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<bigint>, times array<int>"


def align_batches(paths: tuple[str, str]):
    """A row for each text: counts, the digest of its groups, its distinct pairs and how often it has them."""

    def of(batches):
        made = aligner(paths)
        for batch in batches:
            n_a, n_b, n_groups, digests, pairs, times = [], [], [], [], [], []
            for parts in made.each(batch.column("text")):
                distinct, n = np.unique(np.frombuffer(b"".join([p.pairs for p in parts]), "<i8"), return_counts=True)
                n_a.append(sum([p.n_a for p in parts]))
                n_b.append(sum([p.n_b for p in parts]))
                n_groups.append(int(n.sum()))
                digests.append(hashlib.sha256(";".join([p.groups for p in parts]).encode()).hexdigest() if parts else "")
                pairs.append(distinct)
                times.append(n.astype(np.int32))
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), lists(pairs, np.int64), lists(times, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROW.split(", ")])

    return of


def lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def gather_batches(batches):
    """(pair, n): a task's counts of pairs, so that a pair is few rows however many texts have it."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    for batch in batches:
        more, times = batch.column("pairs").flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
        keys, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, times]), len(keys)).astype(np.int64)
        if len(keys) > GATHERED:
            yield rows()
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield rows()


class Frequent:
    """The counts of frequent pairs as sorted arrays."""

    def __init__(self, table: pa.Table) -> None:
        order = np.argsort(pair := table.column("pair").to_numpy())
        self.pair = pair[order]
        self.n, self.best = (table.column(c).to_numpy()[order] for c in ("n", "best"))


def sum_batches(sent):
    """Sums over the frequent pairs of each row; the pairs that aren't frequent stay with it."""

    def of(batches):
        known: Frequent = sent.value
        for batch in batches:
            pair, row = flat(batch.column("pairs"))
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known.pair, pair), max(len(known.pair) - 1, 0))
            met = known.pair[at] == pair if len(known.pair) else np.zeros(len(pair), bool)
            total, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row[met], times[met] * known.n[at[met]])
            np.add.at(best, row[met], times[met] * known.best[at[met]])
            rest = np.flatnonzero(~met)
            bounds = pa.array(np.searchsorted(row[rest], np.arange(batch.num_rows + 1)).astype(np.int32))
            columns = [batch.column("id"), pa.array(total), pa.array(best), *(pa.ListArray.from_arrays(bounds, pa.array(x[rest])) for x in (pair, times))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "count_sum", "n_best", "pairs", "times"])

    return of


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether none of its second id has more."""
    totals = staged(rows.select("pairs", "times").mapInArrow(gather_batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-totals")
    second = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    highest = totals.groupBy(second.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary at most
    return totals.join(F.broadcast(highest), second == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def threshold(counts: DataFrame, most: int) -> int:
    """The least power of two that no more than ``most`` pairs reach."""
    power = F.floor(F.log2("n") + 1e-9).cast("int")
    sizes = {r["p"]: r["k"] for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 63 rows at most
    so_far, least = 0, 0
    for p in sorted(sizes, reverse=True):
        so_far += sizes[p]
        if so_far > most:
            least = p + 1
            break
    return 1 << least


def align(docs: DataFrame, paths: tuple[str, str] | None = None, sent: int = SENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Token counts of both tokenizers, groups between the byte offsets where tokens of both end, and links: the pairs of
    tokens whose byte ranges end together, one in each group. A pair's count is its links in all rows; n_best are the
    links whose count is the highest of their second id, ties included. Texts that are null, empty or that a tokenizer
    doesn't give back byte for byte have zeros and an empty digest. A null doc_id is carried along; rows that repeat are
    counted each on its own; other columns are ignored; no rows, no rows.

    Up to ``sent`` pairs, those of the largest counts, go to all tasks as a table; the rows' other pairs are joined.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(docs.mapInArrow(align_batches(paths or default_paths()), ROW).withColumn("id", F.monotonically_increasing_id()), "align-rows")
    counts = staged(pair_counts(rows), "align-counts")
    least = threshold(counts, sent)
    known = spark.sparkContext.broadcast(Frequent(counts.where(F.col("n") >= least).toArrow()))  # ``sent`` rows at most
    summed = rows.select("id", "pairs", "times").mapInArrow(sum_batches(known), "id long, count_sum long, n_best long, pairs array<bigint>, times array<int>")
    summed = staged(summed, "align-sums")
    rare = summed.select("id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least), "pair")
    met = met.select("id", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"))
    sums = summed.select("id", "count_sum", "n_best").unionByName(met).groupBy("id").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    own = rows.select("id", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    return own.join(sums, "id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_groups(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, groups): each row's groups as structs of both tokenizers' ids, in order; rows without tokens have none."""
    found_by = paths or default_paths()

    def of(batches):
        made = aligner(found_by)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        ids = lambda s: [int(x) for x in s.split(",")]
        for batch in batches:
            rows = []
            for parts in made.each(batch.column("text")):
                groups = [g.split("|") for p in parts for g in p.groups.split(";")]
                rows.append([{"a": ids(a), "b": ids(b)} for a, b in groups])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(load(spark, sf_dir, "documents"))


QUERIES = {"op11_alignment": op11_alignment}
ORACLE_SQL: dict[str, str] = {}
