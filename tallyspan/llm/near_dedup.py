"""MinHash near-duplicate detection.

128 universal hash minima per set of word shingles are cut into 32 bands of 4. Documents with equal
sets count as one class. Within a bucket of a band, classes are held against the smallest of the
bucket first; signatures screen a pair and its full sets confirm it. Links are closed into components
by large-star and small-star. What then shares a bucket but no component is compared in blocks,
until no such pair is left, so large buckets cost no pair that isn't needed and lose no link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_name, load, staged
from .components import components
from .tokens import shingles

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: At 0.75 a pair misses all 32 bands five times in a million, and has fewer than 68 equal minima of 128 three times
#: in a hundred million.
SCREEN = 68
THRESHOLD = 75
U_BLOCK, M_BLOCK = 256, 512

_draw = np.random.default_rng(1)
A = _draw.integers(1, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
B = _draw.integers(0, 2**64, HASHES, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of (a x + b) mod 2^64 over 32-bit x, upper half: universal by multiply, add and shift."""
    x = found >> np.uint64(32)
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (x[at : at + 1024, None] * A + B).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def sketch_batches(batches):
    for batch in batches:
        n, keys, signatures = [], [], []
        for found in shingles(batch.column("text")):
            n.append(len(found))
            keys.append(hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest() if len(found) else None)
            signatures.append(signature(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"]
        )


def set_batches(batches):
    for batch in batches:
        found = list(shingles(batch.column("text")))
        short = [np.unique(x >> np.uint64(32)).astype("<u4").tobytes() for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array(short, pa.binary())], ["id", "set", "short"])


def band_batches(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), sig.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            key = (key ^ sig[:, :, r]) * np.uint64(0xC2B2AE3D27D4EB4F)
            key = key ^ (key >> np.uint64(31))
        key = (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)  # a bucket's key ends in its band
        ids = np.repeat(batch.column("rep").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["bucket", "rep"])


def agreeing(left: pd.Series, right: pd.Series) -> np.ndarray:
    as_matrix = lambda s: np.frombuffer(b"".join(s), "<u4").reshape(-1, HASHES)
    return (as_matrix(left) == as_matrix(right)).sum(axis=1)


def screened(frames):
    for f in frames:
        if len(f):
            yield f.loc[agreeing(f["sig_a"], f["sig_b"]) >= SCREEN, ["a", "b"]]


def cross_links(f: pd.DataFrame) -> pd.DataFrame:
    """Links of a block of a bucket between different components; every pair in its first common band.

    Signatures screen a pair, sets of 32-bit shingle hashes (two of slack) decide: what isn't a link
    leaves no row.
    """
    us, ms = f[f["minor"]], f[~f["minor"]]
    out = []
    if len(us) and len(ms):
        band = int(f["bucket"].iloc[0]) & (BANDS - 1)
        sig = np.frombuffer(b"".join(ms["signature"]), "<u4").reshape(-1, HASHES)
        rep, comp, main = ms["rep"].to_numpy(), ms["comp"].to_numpy(), ms["is_main"].to_numpy()
        sets = [np.frombuffer(x, "<u4") for x in ms["short"]]
        for u, c, s, short in zip(us["rep"], us["comp"], us["signature"], us["short"]):
            equal = sig == np.frombuffer(s, "<u4")
            hit = (equal.sum(axis=1) >= SCREEN) & (comp != c) & (main | (rep < u))
            at = np.flatnonzero(hit)
            at = at[equal[at].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            own = np.frombuffer(short, "<u4")
            for i in at:
                shared = len(np.intersect1d(own, sets[i], assume_unique=True)) + 2
                if 100 * shared >= THRESHOLD * (len(own) + len(sets[i]) - shared):
                    out.append((min(u, rep[i]), max(u, rep[i])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


class Linker:
    """Confirms candidate pairs of classes and keeps their components."""

    def __init__(self, spark: SparkSession, signatures: DataFrame, sets: DataFrame) -> None:
        self.signatures, self.sets = signatures, sets
        self.links = spark.createDataFrame([], "a long, b long")
        self.comps = spark.createDataFrame([], "node long, component long")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs with 100 * intersection >= 75 * union on their full sets."""
        sig = lambda side: self.signatures.select(F.col("rep").alias(side), F.col("signature").alias(f"sig_{side}"))
        near = staged(pairs.join(sig("a"), "a").join(sig("b"), "b").mapInPandas(screened, "a long, b long"), "near-screened")
        sets = lambda side: self.sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}"))
        shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        joined = near.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).cast("long").alias("total"))
        return joined.where(100 * F.col("shared") >= THRESHOLD * (F.col("total") - F.col("shared"))).select("a", "b")

    def add(self, links: DataFrame) -> None:
        self.links = staged(self.links.unionByName(links), "near-links")
        self.comps = components(self.links)

    def component_of(self, df: DataFrame, node: str, name: str) -> DataFrame:
        comps = self.comps.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return df.join(comps, df[node] == F.col("_node"), "left").withColumn(name, F.coalesce("_component", node)).drop("_node", "_component")

    def apart(self, pairs: DataFrame) -> DataFrame:
        return staged(self.component_of(self.component_of(pairs, "a", "comp_a"), "b", "comp_b").where("comp_a <> comp_b").drop("comp_a", "comp_b"), "near-apart")

    def work_off(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b, weight): the heaviest of each b first, then what lies apart still."""
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("weight", -F.col("a"))).alias("a"))
        self.add(self.confirm(best))
        left = self.apart(pairs)
        if not left.isEmpty():
            self.add(self.confirm(left.select("a", "b")))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (set_key, rep, component) of all classes of equal shingle sets."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = staged(docs.mapInArrow(sketch_batches, "doc_id long, n_shingles long, set_key binary, signature binary"), "near-sketches")
    linked = sketches.where("doc_id is not null and set_key is not null")
    classes = staged(linked.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "near-classes")
    keyed = linked.select("set_key", F.col("doc_id").alias("rep"), "signature")
    signatures = staged(keyed.join(classes, ["set_key", "rep"]).dropDuplicates(["rep", "set_key"]), "near-signatures")

    # An id that comes with several texts is one node: its classes are linked
    members = linked.select("doc_id", "set_key").join(classes, "set_key")
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    same_id = staged(members.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "near-same-id")

    bands = signatures.select("rep", "signature").mapInArrow(band_batches, "bucket long, rep long")
    buckets = staged(bands.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z").select("bucket", "a", "n"), "near-buckets")
    shared = staged(bands.join(buckets, "bucket").select("bucket", "a", "n", "rep"), "near-shared")
    stars = shared.where("rep <> a").groupBy("a", F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    wanted = staged(shared.select(F.col("rep").alias("doc_id")).distinct(), "near-wanted")
    sets = staged(docs.join(wanted, "doc_id").mapInArrow(set_batches, "id long, set array<bigint>, short binary"), "near-sets")

    linker = Linker(spark, signatures, sets)
    linker.links = same_id
    linker.work_off(staged(stars, "near-stars"))
    rest = staged(rest_pairs(linker, shared.where("n > 2"), signatures, sets), "near-rest")
    if not rest.isEmpty():
        linker.add(linker.confirm(rest))
    reps = classes.select("set_key", "rep")
    return sketches, linker.component_of(reps, "rep", "component")


def rest_pairs(linker: Linker, shared: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between classes that share a bucket but no component so far.

    In each bucket, all but its largest component are held against the whole bucket, in blocks of
    bounded size. Blocks compare, and only links come out.
    """
    comp = staged(linker.component_of(shared.select("bucket", "rep"), "rep", "comp"), "near-comp")
    mixed = comp.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    sizes = comp.join(mixed, "bucket").groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("minors"))
    rows = staged(comp.join(staged(largest, "near-mixed"), "bucket"), "near-mixed-rows")
    u_blocks, m_blocks = F.ceil(F.col("minors") / U_BLOCK), F.ceil(F.col("members") / M_BLOCK)
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    is_main = (F.col("comp") == F.col("main")).alias("is_main")
    minor = rows.where("comp <> main").select("bucket", "rep", "comp", is_main, F.lit(True).alias("minor"), (spread % u_blocks).alias("ub"), F.explode(F.sequence(F.lit(0).cast("long"), m_blocks - 1)).alias("mb"))
    every = rows.select("bucket", "rep", "comp", is_main, F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0).cast("long"), u_blocks - 1)).alias("ub"), (spread % m_blocks).alias("mb"))
    known = signatures.select("rep", "signature").join(rows.select("rep").distinct(), "rep").join(sets.select(F.col("id").alias("rep"), "short"), "rep")
    known = staged(known.dropDuplicates(["rep", "signature"]), "near-known")
    found = minor.unionByName(every).join(known, "rep").groupBy("bucket", "ub", "mb").applyInPandas(cross_links, "a long, b long")
    return found.distinct()


def decide(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set is the distinct runs of five words,
    or the whole sequence if it is shorter. Null and empty texts have no shingles and no links. An id
    stays if it is the smallest of its component. A null doc_id takes no part: its component is null
    and it stays. Rows that repeat an id are one node: they share a component, and n_shingles is
    each row's own. Other columns are ignored; empty in, empty out.
    """
    sketches, classes = near_classes(docs)
    per_row = sketches.select("doc_id", "n_shingles", "set_key").join(staged(classes, "near-components"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return per_row.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest id of each component; same columns."""
    gone_id = column_name(docs, "near_gone")
    gone = staged(decide(docs).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "near-gone")
    return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
ex AS (SELECT doc_id, unnest(s) AS x FROM sh),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sh),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM ex a JOIN ex b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON reach.r = sym.a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, comp.component_id, n.doc_id = comp.component_id AS kept FROM n JOIN comp USING (doc_id)
"""

QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLE_SQL = {"op10_near_dedup": ORACLE}
