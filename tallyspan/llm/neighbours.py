"""Nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative quantisation) turns vectors into
64-bit codes. Codes are cut into eight substrings, each with its own index from substring to rows. By the
pigeonhole principle a code within Hamming radius R of a query agrees with it in some substring up
to R // 8 flips, so probing those keys retrieves every such code; its vector is then ranked by exact
distance. R is the least radius that holds the wanted share of true neighbours in the sample.

All vectors are indexed, in blocks of bounded size, where they lie. The stated queries are sent to them in chunks of
bounded size; a partition keeps each query's nearest and returns those: neither vectors nor candidates are shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, load, staged

BITS, PARTS = 64, 8
PART_BITS = BITS // PARTS
#: Vectors that the rotation and the radius are learned on, at most; all are indexed.
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
SAMPLE_QUERIES = 256
#: Share of true neighbours that the radius has to hold in the sample.
RECALL = 0.97
#: Bytes of the vectors in a block, and of a chunk of queries.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 16 << 20
#: One of so many vectors is searched first, for bounds of the distances that matter.
EARLY = 64
K = 10
POPCOUNT = np.array([bin(i).count("1") for i in range(1 << PART_BITS)], np.uint8)
#: Substring keys by their Hamming distance from a key.
FLIPS = [np.flatnonzero(POPCOUNT == d) for d in range(PART_BITS + 1)]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the vectors that take part: no nulls, all components finite, not all zero, of the usual length."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite & some, F.lit(False)))


class Codes:
    """The learned codes: mean, rotation and search radius."""

    def __init__(self, sample: np.ndarray, k: int = K, recall: float = RECALL) -> None:
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        size = sample.shape[1]
        rng = np.random.default_rng(3)
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        # fewer dimensions than bits: random directions make up the rest
        extra = rng.normal(size=(size, max(0, BITS - size)))
        basis = np.concatenate([axes[:, :BITS], extra / np.maximum(np.linalg.norm(extra, axis=0), 1e-12)], axis=1)
        v = centred @ basis
        turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(30):
            u, _, wt = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ wt).T
        self.rotation = basis @ turn
        self.radius = self.learn_radius(sample, k, recall)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of eight substrings."""
        return np.packbits((x - self.mean) @ self.rotation >= 0, axis=1)

    def learn_radius(self, x: np.ndarray, k: int, recall: float) -> int:
        if len(x) < 2:
            return BITS
        q = np.arange(0, len(x), max(1, len(x) // SAMPLE_QUERIES))
        codes, found = self.parts(x), []
        for i in q:
            d = ((x - x[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argpartition(d, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
            found.append(POPCOUNT[codes[near] ^ codes[i]].sum(axis=1))
        return int(np.quantile(np.concatenate(found), recall, method="higher"))


class Block:
    """The index of a block: for each substring, its rows by key."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.rows = [np.argsort(codes[:, p], kind="stable") for p in range(PARTS)]
        self.starts = [np.searchsorted(codes[r, p], np.arange((1 << PART_BITS) + 1)) for p, r in enumerate(self.rows)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within the radius: probes of each substring, then the whole code."""
        hit = np.zeros(len(self.codes), bool)
        flips = np.concatenate(FLIPS[: radius // PARTS + 1])
        for p in range(PARTS):
            starts, rows = self.starts[p], self.rows[p]
            for key in flips ^ code[p]:
                hit[rows[starts[key] : starts[key + 1]]] = True
        at = np.flatnonzero(hit)
        return at[POPCOUNT[self.codes[at] ^ code].sum(axis=1) <= radius]


class Nearest:
    """Running k nearest of each query, nearest first, ties to the smaller id; none beyond the query's bound."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int) -> None:
        self.codes, self.ids, self.vectors, self.bounds, self.k = codes, ids, vectors, bounds, k
        self.probes = codes.parts(vectors)
        self.found = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def search(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take in a block: where a query has no bound and fewer than k found with it, the radius grows until it has k or all."""
        block = Block(self.codes.parts(x))
        for q, (qid, v, code, bound) in enumerate(zip(self.ids, self.vectors, self.probes, self.bounds)):
            radius, so_many = self.codes.radius, len(self.found[q][0])
            while True:
                at = block.within(code, radius)
                at = at[ids[at] != qid]
                if np.isfinite(bound) or so_many + len(at) >= self.k or radius >= BITS:
                    break
                radius = min(BITS, radius + PARTS)
            d = np.sqrt(((x[at] - v) ** 2).sum(axis=1))
            at, d = at[d <= bound], d[d <= bound]
            near, so_far = self.found[q]
            near, so_far = np.concatenate([near, ids[at]]), np.concatenate([so_far, d])
            if len(near) > self.k:
                most = np.partition(so_far, self.k - 1)[self.k - 1]
                near, so_far = near[so_far <= most], so_far[so_far <= most]
            order = np.lexsort((near, so_far))[: self.k]
            self.found[q] = near[order], so_far[order]

    def rows(self) -> pd.DataFrame:
        sizes = [len(near) for near, _ in self.found]
        return pd.DataFrame({"query_id": np.repeat(self.ids, sizes), "vec_id": np.concatenate([n for n, _ in self.found]), "score": np.concatenate([d for _, d in self.found])})


def searcher(asked, codes: Codes, k: int, size: int):
    """Over a partition's vectors, block by block: the k nearest of each query in it. ``asked`` is a broadcast (ids, vectors, bounds)."""
    most = max(1, BLOCK_BYTES // (8 * size))

    def of(frames):
        nearest_of = Nearest(codes, *asked.value, k)
        held, rows = [], 0
        for f in frames:
            for at in range(0, len(f), most):
                part = f.iloc[at : at + most]
                held.append((part["id"].to_numpy(), np.stack(part["vector"])))
                rows += len(part)
                if rows >= most:
                    nearest_of.search(*(np.concatenate(x) for x in zip(*held)))
                    held, rows = [], 0
        if rows:
            nearest_of.search(*(np.concatenate(x) for x in zip(*held)))
        yield nearest_of.rows()

    return of


def nearest(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest others found, by Euclidean distance.

    Nearest first, ties to the smaller id. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do null ids; nor do vectors of a length other than the commonest. Rows that
    repeat a query's id aren't its neighbours and ask once (with the least of their vectors); rows that repeat
    an id are each a candidate. Where there are fewer than k candidates, all are returned; without vectors nothing is.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = staged(usable(vectors, id_column, vector_column), "ann-vectors")
    lengths = good.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    size = lengths["size"]
    good = good.where(F.size("vector") == size)
    asked = usable(queries, id_column, vector_column).where(F.size("vector") == size).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = staged(asked, "ann-queries")
    taken = good.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))).select("vector").collect()
    codes = Codes(np.array([r["vector"] for r in taken]), k)

    # vectors stay where they lie: a chunk of queries of bounded size is sent to all of them, and only the found come back.
    # The k-th nearest of a share of the vectors bounds what of the others can be found, so that few come back from each task
    chunks = max(1, -(-asked.count() * 8 * size // CHUNK_BYTES))
    parts, kind = [], "query_id long, vec_id long, score double"
    early = F.pmod(F.xxhash64(F.lit("early"), "id"), F.lit(EARLY)) == 0
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    for chunk in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).orderBy("id").collect()  # CHUNK_BYTES, about
        if rows:
            ids, x = np.array([r["id"] for r in rows]), np.array([r["vector"] for r in rows])
            sent = spark.sparkContext.broadcast((ids, x, np.full(len(ids), np.inf)))
            first = good.where(early).mapInPandas(searcher(sent, codes, k, size), kind)
            first = staged(first.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k), "ann-early")
            kth = {r["query_id"]: r["score"] for r in first.where(F.col("rank") == k).select("query_id", "score").collect()}  # a number for each query sent
            bounded = spark.sparkContext.broadcast((ids, x, np.array([kth.get(i, np.inf) for i in ids.tolist()])))
            parts += [first.drop("rank"), staged(good.where(~early).mapInPandas(searcher(bounded, codes, k, size), kind), "ann-found")]
            sent.destroy()
            bounded.destroy()
    if not parts:
        return spark.createDataFrame([], schema)
    discard(asked)
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding")


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLE_SQL: dict[str, str] = {}
