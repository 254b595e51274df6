"""Packing token sequences by non-negative least squares over the length histogram.

Documents are cut into full windows and one remainder. Combinations of up to three lengths that fill a
window are enumerated; least squares finds how often to repeat each so that together they use up the
histogram of lengths; repeats are rounded down, and what is left is packed greedily, cut where a window is
full. The driver sees the histogram and the plan, whose sizes are fixed; pieces find their places
by their rank within a length.
"""

from __future__ import annotations

import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, staged
from .tokenize import default_path, word_tokenizer

WINDOW = 2048
END = 1
#: Lengths are counted in units of so many tokens, rounded up.
UNIT = 8
#: A remainder can be cut at multiples of so many tokens.
CHUNK = 16
#: What the greedy packing puts into a window; the next cut comes less than a chunk later.
FILL = WINDOW - CHUNK
#: Pieces of one length are ranked in groups of about so many.
GROUP = 20_000
PIECES = "doc_id long, start long, length long, crc long, doc_tokens long, chunks array<long>"


def parts_of(batches, rows: int):
    """Batches of so many rows at most: what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def piece_batches(path: str):
    def of(batches):
        tokenizer = word_tokenizer(path)
        end = np.array([END], "<u4").tobytes()
        for batch in parts_of(batches, 512):
            rows: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc, raw in zip(ids, tokenizer.encode(batch.column("text").to_pylist())):
                raw = memoryview(raw + end)
                n = len(raw) // 4
                for start in range(0, n, WINDOW):
                    part = raw[4 * start : 4 * (start + WINDOW)]
                    short = len(part) < 4 * WINDOW
                    chunks = [zlib.crc32(part[a : a + 4 * CHUNK]) for a in range(0, len(part), 4 * CHUNK)] if short else None
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, chunks))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "crc", "doc_tokens", "chunks"])

    return of


# --- the plan ----------------------------------------------------------------------------------


def combinations(units: int) -> list[tuple[int, ...]]:
    """Multisets of two or three lengths that fill a window of so many units."""
    pairs = [(units - a, a) for a in range(1, units // 2 + 1)]
    return pairs + [(units - a - b, b, a) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """argmin |a x - y| over x >= 0 by active sets; a round beyond the bound leaves more to the greedy packing."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (y - a @ x)
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * (1 + np.abs(y).max()):
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            part = a[:, at]
            square = part.T @ part
            z = np.linalg.solve(square + 1e-9 * np.eye(len(at)), part.T @ y)
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            falling = z <= 0
            step = np.min(x[at][falling] / np.maximum(x[at][falling] - z[falling], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= 1e-12) & falling]
            if not len(gone):
                gone = at[falling][:1]
            x[gone], used[gone] = 0, False
    return x


def strategies(histogram: dict[int, int], units: int = WINDOW // UNIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): full windows alone, then the rounded solution, never beyond the histogram."""
    left = dict(histogram)
    plan = [((units,), left.pop(units))] if left.get(units) else []
    combos = [c for c in combinations(units) if all(p in left for p in c)]
    if not combos:
        return plan
    a = np.zeros((units, len(combos)))
    for j, c in enumerate(combos):
        for p in c:
            a[p, j] += 1
    y = np.array([left.get(u, 0) for u in range(units)], float)
    x = nnls(a, y)
    for j in np.argsort(-x, kind="stable"):
        most = min(left[p] // combos[j].count(p) for p in combos[j])
        n = min(int(np.floor(x[j] + 1e-6)), most)
        if n > 0:
            plan.append((combos[j], n))
            for p in combos[j]:
                left[p] -= n
    return plan


# --- cutting what the greedy packing cuts ------------------------------------------------------


def crc_shift(crc: int, count: int) -> int:
    """The CRC-32 register after ``count`` more zero bytes (a polynomial times x^(8 count))."""
    poly, power, bits = 0xEDB88320, 1 << 30, 8 * count  # power: x^1, reflected

    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                out ^= b
            b = (b >> 1) ^ (poly if b & 1 else 0)
        return out

    factor = 1 << 31
    while bits:
        if bits & 1:
            factor = times(power, factor)
        power = times(power, power)
        bits >>= 1
    return times(factor, crc)


_shift_columns: dict[int, list[int]] = {}


def crc_join(first: int, second: int, count: int) -> int:
    """CRC-32 of two byte strings one after the other; the second has ``count`` bytes."""
    if count not in _shift_columns:
        _shift_columns[count] = [crc_shift(1 << k, count) for k in range(32)]
    for k, column in enumerate(_shift_columns[count]):
        if first >> k & 1:
            second ^= column
    return second


def cut_batches(batches):
    """Residual pieces with their place ``at`` in the row of all residual tokens, cut at window bounds."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            bounds, n, at = [0], r["length"], r["at"]
            edge = (at // FILL + 1) * FILL
            while edge < at + n:
                cut = -(-(edge - at) // CHUNK) * CHUNK
                if bounds[-1] < cut < n:
                    bounds.append(cut)
                edge += FILL
            bounds.append(n)
            for a, b in zip(bounds[:-1], bounds[1:]):
                crc = r["crc"]
                if b - a < n:
                    crc = 0
                    for k in range(a // CHUNK, -(-b // CHUNK)):
                        crc = crc_join(crc, r["chunks"][k], 4 * (min(b, (k + 1) * CHUNK) - k * CHUNK))
                out.append((r["doc_id"], r["start"] + a, b - a, crc, r["doc_tokens"], (at + a) // FILL, at + a))
        columns = zip(*out) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "crc", "doc_tokens", "window", "slot"])


# --- the operator ------------------------------------------------------------------------------


def in_groups_before(sums: DataFrame, value: str, groups: int) -> DataFrame:
    """(units, grp, before): the sum of ``value`` over the groups of the same units that come before.

    Prefix sums of blocks, then within blocks: a length that most pieces have is some sqrt(groups) rows in a task.
    """
    block = max(1, isqrt(groups))
    blocked = sums.select("units", "grp", F.col(value).alias("value"), F.floor(F.col("grp") / block).alias("block"))
    along = lambda keys, place: Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda keys, place: F.coalesce(F.sum("value").over(along(keys, place)), F.lit(0))
    blocks = blocked.groupBy("units", "block").agg(F.sum("value").alias("value")).select("units", "block", so_far(["units"], "block").alias("blocks_before"))
    inner = blocked.withColumn("inner", so_far(["units", "block"], "grp"))
    return inner.join(blocks, ["units", "block"]).select("units", "grp", (F.col("inner") + F.col("blocks_before")).alias("before"))


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of a document (those of its text, then id 1) lies in one piece; a sequence holds up to
    2048 ids. A null or empty text is the id 1 alone; a null doc_id is carried along; rows that repeat
    are packed each on its own; other columns are ignored; no rows, no pieces. Sequence ids don't
    depend on partitioning.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.mapInArrow(piece_batches(tokenizer_path or default_path()), PIECES)
    pieces = staged(found.withColumn("units", F.ceil(F.col("length") / UNIT).cast("int")), "pack-pieces")
    histogram = {r["units"]: r["n"] for r in pieces.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}  # WINDOW / UNIT rows at most
    plan = strategies(histogram)

    # rank of each piece within its length: groups by hash, and how many pieces lie in the groups before
    groups = max(256, sum(histogram.values()) // GROUP)
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(groups)))
    ahead = in_groups_before(grouped.groupBy("units", "grp").agg(F.count(F.lit(1)).alias("n")), "n", groups).withColumnRenamed("before", "ahead")

    slots, taken, base = [], {}, 0
    for number, (parts, repeats) in enumerate(plan):
        for slot, u in enumerate(sorted(set(parts), reverse=True)):
            m = parts.count(u)
            slots.append((u, taken.get(u, 0), taken.get(u, 0) + m * repeats, base, m, slot * 4))
            taken[u] = taken.get(u, 0) + m * repeats
        base += repeats
    used = spark.createDataFrame([(u, taken.get(u, 0)) for u in histogram] or [(0, 0)], "units int, used long")

    order = Window.partitionBy("units", "grp").orderBy("doc_id", "start", "crc", "length")
    in_group = grouped.withColumn("place", F.row_number().over(order) - 1).join(staged(ahead, "pack-groups"), ["units", "grp"])
    ranked = in_group.withColumn("rank", F.col("place") + F.col("ahead")).join(F.broadcast(used), "units")
    rest = F.col("rank") >= F.col("used")
    ranked = staged(ranked.select("doc_id", "start", "length", "crc", "doc_tokens", "units", "grp", "rank", rest.alias("rest"), F.when(rest, F.col("chunks")).alias("chunks")), "pack-ranked")

    slot_table = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "units int, lo long, hi long, base long, m int, slot0 int")
    local = F.col("rank") - F.col("lo")
    planned = ranked.where("not rest").join(F.broadcast(slot_table), "units").where("rank >= lo and rank < hi")
    planned = planned.select("doc_id", "start", "length", "crc", "doc_tokens", (F.col("base") + F.floor(local / F.col("m"))).alias("sequence_id"), (F.col("slot0") + local % F.col("m")).alias("slot"))

    # the rest in one row of tokens: long pieces first, then by group and rank
    left = ranked.where("rest")
    sums = left.groupBy("units", "grp").agg(F.sum("length").alias("tokens"))
    by_units = sums.groupBy("units").agg(F.sum("tokens").alias("tokens")).collect()  # WINDOW / UNIT rows at most
    firsts, total = [], 0
    for r in sorted(by_units, key=lambda r: -r["units"]):
        firsts.append((r["units"], total))
        total += r["tokens"]
    first_table = spark.createDataFrame(firsts or [(0, 0)], "units int, first long")
    starts = in_groups_before(sums, "tokens", groups).withColumnRenamed("before", "group_first").join(F.broadcast(first_table), "units")
    running = Window.partitionBy("units", "grp").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = left.withColumn("inner_first", F.coalesce(F.sum("length").over(running), F.lit(0))).join(staged(starts, "pack-starts"), ["units", "grp"])
    rows = placed.select("doc_id", "start", "length", "crc", "doc_tokens", "chunks", (F.col("first") + F.col("group_first") + F.col("inner_first")).alias("at"))
    cut = rows.mapInArrow(cut_batches, "doc_id long, start long, length long, crc long, doc_tokens long, window long, slot long")
    greedy = cut.select("doc_id", "start", "length", "crc", "doc_tokens", (F.col("window") + base).alias("sequence_id"), "slot")

    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("long").alias("offset")
    return planned.unionByName(greedy).select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", offset)


def packed_sequences(docs: DataFrame, pieces: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, unpadded, of ``pack``'s pieces of documents with distinct ids."""
    path = tokenizer_path or default_path()

    def of(batches):
        tokenizer = word_tokenizer(path)
        for batch in batches:
            texts = tokenizer.encode(batch.column("text").to_pylist())
            ids = [np.append(np.frombuffer(raw, "<u4"), END)[s : s + n] for raw, s, n in zip(texts, batch.column("start").to_pylist(), batch.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("offset"), pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])

    parts = pieces.select("doc_id", "start", "length", "sequence_id", "offset").join(docs.select("doc_id", "text"), "doc_id")
    found = parts.mapInArrow(of, "sequence_id long, offset long, ids array<long>")
    in_order = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
