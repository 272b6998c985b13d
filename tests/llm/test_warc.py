import hashlib
import os

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from corpusloom.llm import warc
from corpusloom.llm.queries import oracle_sql, queries

MAGIC = warc.MAGIC
FORGED = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
BIG = "<p>" + "text " * 60 + "</p>"
PAGES = [
    (1, "http://a/ \r\n", BIG),
    (2, None, BIG),
    (3, "http://b/", "small"),
    (4, "http://c/", "small"),
    (5, "http://d/", None),
    (6, "http://e/", ""),
    (7, "http://f/", FORGED * 3),
    (8, "http://g/", MAGIC),
    (9, "http://h/", "ends with WARC/1.1"),
    (10, "http://i/", MAGIC * 50 + "Ünïcode 🙂\r\n\r\n"),
    (11, "http://j/", f"{MAGIC}Content-Length: 99999999\r\nWARC-Type: response\r\n\r\n"),
    (12, "http://k/", ("x" * 5000 + FORGED) * 40),
    (None, "http://l/", BIG),
    (2, "http://m/", BIG),
]


@pytest.fixture
def pages(spark):
    rows = [(i, u, h, "x", "y") for i, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, value string")


def test_query_equals_sql(spark, small):
    assert compare(queries()["op6_warc"](spark, small), connect(small), oracle_sql()["op6_warc"]) is None


@pytest.mark.parametrize("split", ["128m", "7k", "700"])
def test_round_trip_with_magic_in_payloads(spark, pages, tmp_path, split):
    """Byte ranges from whole files down to a few hundred bytes give the same records."""
    path = str(tmp_path / "w")
    warc.write_warc(pages.coalesce(2), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.resolved(warc.read_warc(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((r.page or "", r.record_type, r.refers, r.payload_bytes, r.digest) for r in rows)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        again = len(raw) >= 100 and html == BIG and i != 1
        want.append((str(i or ""), "revisit" if again else "response", "1" if again else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or "", r[3], r[4]))


def test_files_are_plain_records(pages, tmp_path):
    """A reader that walks a file by its lengths finds the records one after another."""
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    found = 0
    for name in os.listdir(path):
        if name.startswith("part-"):
            data = open(os.path.join(path, name), "rb").read()
            at = 0
            while at < len(data):
                assert data[at:].startswith(MAGIC.encode())
                stop = data.index(b"\r\n\r\n", at)
                size = int(data[at:stop].split(b"Content-Length: ")[1])
                assert data[stop + 4 + size : stop + 8 + size] == b"\r\n\r\n"
                at = stop + 8 + size
                found += 1
    assert found == len(PAGES)


def test_damaged_payload_is_an_error(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages.where("page_id = 3").coalesce(1), path)
    for name in os.listdir(path):
        full = os.path.join(path, name)
        if name.startswith("part-"):
            data = open(full, "rb").read().replace(b"small", b"smell")
            open(full, "wb").write(data)
        elif name.endswith(".crc"):
            open(full, "wb").close()
            os.rename(full, full + ".old")
    with pytest.raises(Exception, match="differs"):
        warc.read_warc(spark, path).collect()


def test_no_pages(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages.where("false"), path)
    assert warc.read_warc(spark, path).collect() == []


def test_all_ids_null(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages.withColumn("page_id", F.lit(None).cast("long")).where("html = '" + BIG + "'"), path)
    assert {r.record_type for r in warc.read_warc(spark, path).collect()} == {"response"}
