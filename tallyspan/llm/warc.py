"""WARC archives: whole-file gzip streams in, one gzip member per record and a sidecar index out.

Pages are written as monolithic archives (a file is one gzip stream, as plain ``gzip`` makes it). The
normaliser inflates each stream once, in bounded memory, rewrites every record as a member of its own
and notes its place in an index. Readers then take single records by offset.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, load, staged

#: Payloads with fewer bytes are never revisits.
LEAST_REVISIT = 100
CHUNK = 1 << 20
#: Records are read back in ranges of so many compressed bytes.
RANGE = 8 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, record_type string, page_id long, payload_digest string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def opened(path: str):
    """(file system, path in it) of a URI; executors reach the shared folder by it."""
    return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_head(page_id, url, digest: str, size: int, refers_to, revisit: bool) -> bytes:
    """WARC and HTTP headers of a page's record; a response's payload follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_batches(folder: str):
    """Each task writes one monolithic archive; a task that runs again replaces its file as a whole."""

    def of(batches):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name, made, out = f"part-{context.partitionId():05d}.warc.gz", 0, None
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out, gz = fs.open_output_stream(draft, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                body = r["body"].encode()
                revisit = r["record_type"] == "revisit"
                head = record_head(r["page_id"], r["url"], r["digest"], len(body), r["refers_to"], revisit)
                out.write(gz.compress(head + (b"" if revisit else body) + b"\r\n\r\n"))
                made += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([made], pa.int64())], ["file", "records"])

    return of


class Inflated:
    """A gzip file, of one member or many, as a stream that is inflated once."""

    def __init__(self, stream) -> None:
        self.stream, self.gz, self.have = stream, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while True:
            if self.gz.eof:
                raw, self.gz = self.gz.unused_data or self.stream.read(CHUNK), zlib.decompressobj(31)
            else:
                raw = self.gz.unconsumed_tail or self.stream.read(CHUNK)
            if not raw:
                return False
            found = self.gz.decompress(raw, CHUNK)
            if found:
                self.have += found
                return True

    def until(self, mark: bytes) -> bytes:
        """All up to and with ``mark``; empty at the end of the file."""
        at = 0
        while (found := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark))
            if not self.more():
                if self.have.strip():
                    raise ValueError("the archive ends within a record")
                return b""
        out = bytes(self.have[: found + len(mark)])
        del self.have[: len(out)]
        return out

    def take(self, n: int):
        """The next n bytes, in parts."""
        while n:
            if not self.have and not self.more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.have[: min(n, CHUNK)])
            del self.have[: len(part)]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_file(source: str, folder: str) -> tuple[str, int]:
    fs, path = opened(source)
    name = path.rsplit("/", 1)[1]
    out_fs, root = opened(folder)
    for part in ("warc", "index"):
        out_fs.create_dir(f"{root}/{part}", recursive=True)
    tag = f".{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    target, made, place = f"{folder}/warc/{name}", 0, 0
    with fs.open_input_stream(path, compression=None) as stream, out_fs.open_output_stream(f"{root}/warc/{tag}", compression=None) as out, out_fs.open_output_stream(f"{root}/index/{tag}", compression=None) as index:
        inflated = Inflated(stream)
        while head := inflated.until(b"\r\n\r\n"):
            head = head.lstrip(b"\r\n")
            said = fields(head)
            gz = zlib.compressobj(6, zlib.DEFLATED, 31)
            size = out.write(gz.compress(head)) or 0
            for part in inflated.take(int(said["content-length"])):
                size += out.write(gz.compress(part)) or 0
            end = b"".join(inflated.take(4))
            if end != b"\r\n\r\n":
                raise ValueError(f"a record of {source} has no end")
            out.write(gz.compress(end) + gz.flush())
            size = out.tell() - place
            row = (target, place, size, said["warc-type"], said.get("warc-page-id", ""), said.get("warc-payload-digest", "").removeprefix("sha256:"))
            index.write(("\t".join(map(str, row)) + "\n").encode())
            place, made = place + size, made + 1
    out_fs.move(f"{root}/warc/{tag}", f"{root}/warc/{name}")
    out_fs.move(f"{root}/index/{tag}", f"{root}/index/{name}.tsv")
    return target, made


def normalise_batches(folder: str):
    def of(batches):
        for batch in batches:
            done = [normalise_file(f, folder) for f in batch.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "records"])

    return of


def read_batches(batches):
    """Records by their place in the index: seek, inflate one member, part its headers and payload."""
    name, source = None, None
    for batch in batches:
        rows = []
        for r in batch.select(["file", "offset", "length"]).to_pylist():
            if r["file"] != name:
                fs, path = opened(r["file"])
                name, source = r["file"], fs.open_input_file(path)
            source.seek(r["offset"])
            raw = zlib.decompress(source.read(r["length"]), 31)
            head, _, block = raw.partition(b"\r\n\r\n")
            said = fields(head)
            http, _, payload = block[: int(said["content-length"])].partition(b"\r\n\r\n")
            revisit = said["warc-type"] == "revisit"
            digest = said["warc-payload-digest"].removeprefix("sha256:")
            if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"a payload in {name} at {r['offset']} isn't what its digest says")
            size = int(fields(http)["content-length"]) if revisit else len(payload)
            number = lambda k: int(said[k]) if k in said else None
            rows.append((number("warc-page-id"), said.get("warc-target-uri"), size, digest, said["warc-type"], number("warc-refers-to-page-id"), None if revisit else payload))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        columns = zip(*rows) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Monolithic archives of ``pages`` (page_id, url, html) in ``folder``; returns (file, records).

    Of records with equal payloads of 100 bytes or more, those with the smallest page_id are responses
    and the others revisits of it. A null html is an empty payload, a null url is left out. A null
    page_id comes after all others; rows that repeat the smallest id are all responses. Other columns
    are ignored; no pages, no files.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"))
    large = records.where(F.octet_length("body") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    shared = staged(large.where("n > 1 and first_id is not null").select("digest", "first_id"), "warc-shared")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = records.join(shared, "digest", "left").select(
        "page_id", "url", "body", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )
    return staged(marked.mapInArrow(write_batches(folder), "file string, records long"), "warc-files")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``files`` (file) below ``folder``; returns the sidecar index."""
    spark = files.sparkSession
    n = max(1, files.count())
    done = staged(files.select("file").repartition(n, "file").mapInArrow(normalise_batches(folder), "file string, records long"), "warc-normalised")
    if done.isEmpty():
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).csv(f"{folder}/index/*.tsv", sep="\t", quote="")


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Size and digest are those of the full payload; a revisit's own payload is null.
    """
    by_range = index.withColumn("part", F.floor(F.col("offset") / RANGE)).repartition("file", "part").sortWithinPartitions("file", "offset")
    return by_range.mapInArrow(read_batches, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    files = write_archives(load(spark, sf_dir, "pages"), f"{folder}/whole")
    return read_records(normalise(files, folder)).drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {"op4_warc": ORACLE}
