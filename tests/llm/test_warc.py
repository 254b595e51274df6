import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tallyspan.llm import warc

LONG = "é<p>" + "x" * 200
ROWS = [(1, "http://a/ä b\r\nX: y", LONG), (2, "u2", LONG), (3, None, LONG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (1, "again", LONG), (None, "u", LONG), (8, "u", "WARC/1.1\r\n\r\n" * 50), (9, "u", "y" * 3_000_000)]
SCHEMA = "page_id long, url string, html string, digest string, Body string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "b") for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(pages(spark, ROWS).repartition(3), f"{folder}/whole")
    index = warc.normalise(files, folder)
    got = warc.read_records(index).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(i), hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in ROWS)
    assert sorted((str(r["page_id"]), r["payload_digest"], r["payload_bytes"]) for r in got) == want
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == len(LONG.encode()))
    assert kinds == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("3", "revisit", 1), ("None", "revisit", 1)]
    assert all(r["payload"] is None or hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in got)
    # the archives are gzip streams: one for a whole file before, one for each record after
    one = gzip.decompress((tmp_path / "w/whole").glob("*.gz").__next__().read_bytes())
    assert one.startswith(b"WARC/1.1\r\n")
    for r in index.collect():
        raw = open(r["file"].removeprefix("file://"), "rb").read()[r["offset"] : r["offset"] + r["length"]]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n") and gzip.decompress(raw).endswith(b"\r\n\r\n")


def test_streams_of_many_members_and_broken_ones():
    whole = b"".join(gzip.compress(bytes([65 + k]) * 10) for k in range(5))
    s = warc.Inflated(io.BytesIO(whole))
    assert b"".join(s.take(50)) == b"".join(bytes([65 + k]) * 10 for k in range(5)) and s.until(b"\r\n") == b""
    with pytest.raises(ValueError):
        list(warc.Inflated(io.BytesIO(gzip.compress(b"abc"))).take(9))


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    files = warc.write_archives(pages(spark, ROWS).limit(0), f"{folder}/whole")
    assert warc.read_records(warc.normalise(files, folder)).where(F.lit(True)).count() == 0
