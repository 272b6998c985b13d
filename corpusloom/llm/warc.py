"""WARC archives written by Spark and read back in byte ranges with boundary-chain verification.

The magic ``WARC/1.1`` may stand inside payloads, and a task that starts in the middle of a file can't tell. So every
occurrence is a candidate record whose header names its successor's offset, and only candidates on the chain from
the file's start are records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import small_or_shuffled, table
from corpusloom.llm.registry import query
from corpusloom.session import fresh_path, materialize

MAGIC = "WARC/1.1\r\n"
#: Payloads below this size are always stored.
MIN_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> None:
    """One record per row, in uncompressed files of Spark's text writer under ``path``.

    A payload is the page in UTF-8, null counting as empty. Among equal payloads of at least ``MIN_REVISIT`` bytes the rows
    with the smallest id store a response; the others are revisits that carry headers only and refer to it. Rows with a
    null id never count as smallest; when all ids of a payload are null, all are responses. A null url gives no target;
    control characters and blanks in a url are percent-encoded. Other columns are not read.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("string").alias("page"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
        F.col(page_id).alias("id"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
        F.octet_length(payload).alias("size"),
    )
    # Only ids and digests are grouped; while the repeated digests are few, payloads stay where they were read.
    shared = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = shared.where("n > 1").select("digest", "first")
    rows = rows.join(small_or_shuffled(repeated, 200_000), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    safe = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    record = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:page:"), F.coalesce("page", F.lit("")), F.lit(">"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), safe), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"),
        block,
    )
    rows.withColumn("http", http).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


_FIELD = re.compile(rb"(?m)^([A-Za-z-]+): ([^\r\n]*)\r$")
_PAGE = re.compile(rb"<urn:page:([^>]*)>")


def _parsed(chunk: bytes) -> dict | None:
    """The record a chunk (what follows a magic) claims to be; ``size`` counts the bytes up to the next magic."""
    stop = chunk.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(chunk[: stop + 2])}
    length = fields.get(b"content-length", b"")
    if b"warc-type" not in fields or not length.isdigit() or len(length) > 15:
        return None
    page, target = _PAGE.match(fields.get(b"warc-record-id", b"")), _PAGE.match(fields.get(b"warc-refers-to", b""))
    size = stop + 4 + int(length) + 4
    return {
        "size": size,
        "record_type": fields[b"warc-type"].decode("utf-8", "replace"),
        "page": page and page[1].decode("utf-8", "replace"),
        "refers": target and target[1].decode("utf-8", "replace"),
        "uri": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None,
        "said": fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha256:"),
        "payload": _payload(chunk[stop + 4 : -4]) if len(chunk) == size else None,
    }


def _payload(block: bytes) -> bytes:
    """What follows the HTTP headers."""
    return block[block.find(b"\r\n\r\n") + 4 :]


def _exits(rel: np.ndarray, nxt: np.ndarray, total: int) -> np.ndarray:
    """Where the chain from each candidate leaves the block; -1 when it breaks inside."""
    place = {r: i for i, r in enumerate(rel.tolist())}
    out = np.full(len(rel), -1, dtype=np.int64)
    for i in range(len(rel) - 1, -1, -1):
        to = int(nxt[i])
        if to >= total:
            out[i] = to
        elif to in place:
            out[i] = out[place[to]]
    return out


_CHUNKS = "file string, block long, rel long, next long, leaves long, total long, record_type string, page string, refers string, uri string, said string, payload_bytes long, digest string"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the stretches between magics, split over the file's byte ranges."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), (v.as_py() for v in batch.column("value")))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per stretch, with offsets relative to the block's first stretch, and each block's total size."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in _CHUNKS.split(", "))])
    rows: list[dict] = []
    at, now = 0, None

    def done() -> pa.RecordBatch:
        rel = np.array([r["rel"] for r in rows], dtype=np.int64)
        for r, leaves in zip(rows, _exits(rel, np.array([r["next"] for r in rows], dtype=np.int64), at).tolist()):
            r["leaves"] = leaves
        rows[0]["total"] = at
        return pa.RecordBatch.from_pylist(rows, schema)

    for file, block, value in _blocks_in(batches):
        if now != (file, block):
            if rows:
                yield done()
            now, at, rows = (file, block), 0, []
        row = {"file": file, "block": block, "rel": at, "next": -1}
        if found := _parsed(value):
            size, payload = found.pop("size"), found.pop("payload")
            row |= found | {"next": at + size + len(MAGIC)}
            if payload is not None:
                row |= {"payload_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()}
        rows.append(row)
        at += len(value) + len(MAGIC)
    if rows:
        yield done()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, now = 0, None
    for file, block, value in _blocks_in(batches):
        if now != (file, block):
            now, at = (file, block), 0
        yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "rel": [at], "value": [value]})
        at += len(value) + len(MAGIC)


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """One block's stretches: those on the chain from its entry, and the record each of them belongs to."""
    rows = rows.sort_values("at", ignore_index=True)
    place = {a: i for i, a in enumerate(rows["at"].tolist())}
    real = np.zeros(len(rows), dtype=bool)
    starts = np.flatnonzero(rows["entry"].to_numpy())
    i = int(starts[0]) if len(starts) else None
    nxt = rows["to"].tolist()
    while i is not None:
        real[i] = True
        i = place.get(nxt[i])
    owner = np.where(real, np.arange(len(rows)), -1)
    owner = np.maximum.accumulate(owner) if len(rows) else owner
    at = rows["at"].to_numpy()
    return rows.assign(real=real, owner=np.where(owner >= 0, at[owner], -1)).drop(columns=["entry"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record_type, page, refers, uri, payload_bytes, digest) of every record under ``path``.

    Tasks read byte ranges of the files, however large these are, and emit (offset, successor) candidates. Chains
    are shortened inside each range; pointer jumping from the start of every file then doubles its reach over the
    ranges each round, so rounds grow with the logarithm of the number of ranges. ``digest`` is computed from the
    bytes read; a response whose bytes don't give the digest in its header is an error. Revisits have null size and
    their header's digest. An empty folder gives no rows.
    """
    found = materialize(_raw(spark, path).mapInArrow(_candidates, _CHUNKS), "warc-candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.where("total IS NOT NULL").select("file", "block", "total")
    bases = totals.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    start = len(MAGIC)
    placed = found.join(bases, ["file", "block"])
    absolute = lambda c: F.when(F.col(c) >= 0, F.col("base") + F.col(c)).otherwise(-1)
    placed = placed.withColumns({"at": F.col("base") + F.col("rel"), "to": absolute("next"), "leaves": absolute("leaves")})

    # Pointers between ranges: from where a chain enters one to where it leaves it.
    targets = placed.where("leaves >= 0").select("file", F.col("leaves").alias("at")).distinct()
    firsts = placed.where(F.col("at") == start).select("file", "at")
    entries = targets.union(firsts).distinct()
    jump = materialize(placed.where("leaves >= 0").select("file", "at", F.col("leaves").alias("to")).join(entries, ["file", "at"], "left_semi"), "warc-jumps")
    reached = materialize(firsts, "warc-reached")
    while True:
        onward = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        fresh = onward.distinct().join(reached, ["file", "at"], "left_anti")
        grown = materialize(reached.union(fresh), "warc-reached")
        if grown.count() == reached.count():
            break
        reached = grown
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at")), "left")
        jump = materialize(twice.select("a.file", "a.at", F.coalesce("b.to", "a.to").alias("to")), "warc-jumps")

    marked = placed.join(reached.withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    narrow = marked.select("file", "block", "rel", "at", "to", "entry")
    walked = narrow.groupBy("file", "block").applyInPandas(_followed, "file string, block long, rel long, at long, to long, real boolean, owner long")
    walked = materialize(walked, "warc-walked")
    named = found.drop("next", "leaves", "total").join(walked.where("real").select("file", "block", "rel", "at"), ["file", "block", "rel"])
    records = materialize(named, "warc-records")
    cut = records.where("record_type <> 'revisit' AND digest IS NULL").select("file", "at")
    if not cut.isEmpty():
        whole = _joined(spark, path, walked, cut)
        records = records.drop("block", "rel").join(whole, ["file", "at"], "left")
        records = records.withColumns({c: F.coalesce(c, f"whole_{c}") for c in ("payload_bytes", "digest")})
    revisit = F.col("record_type") == "revisit"
    wrong = ~revisit & ~F.col("digest").eqNullSafe(F.col("said"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its digest: "), "file", F.lit(" at "), F.col("at").cast("string")))).otherwise(F.col("digest"))
    return records.select(
        "file", "at", "record_type", "page", "refers", "uri",
        F.when(~revisit, F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("said")).otherwise(checked).alias("digest"),
    )


def _joined(spark: SparkSession, path: str, walked: DataFrame, cut: DataFrame) -> DataFrame:
    """(file, at, whole_payload_bytes, whole_digest) of the records ``cut``, whose payloads hold the magic.

    A second scan fetches the stretches of these records only; a group has one record's bytes.
    """
    blocks = walked.groupBy("file", "block").agg(F.max(F.when(F.col("owner") >= 0, F.col("owner"))).alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.max("last").over(earlier).alias("open"))
    owned = walked.join(blocks, ["file", "block"]).withColumn("owner", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("open")))
    pieces = owned.select("file", "block", "rel", F.col("at").alias("place"), F.col("owner").alias("at")).join(cut, ["file", "at"], "left_semi")
    bytes_ = _raw(spark, path).mapInArrow(_stretches, "file string, block long, rel long, value binary")
    gathered = bytes_.join(pieces, ["file", "block", "rel"]).select("file", "at", "place", "value")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = MAGIC.encode().join(rows.sort_values("place")["value"])
        found = _parsed(chunk)
        payload = found and found["payload"]
        told = {"whole_payload_bytes": [len(payload)], "whole_digest": [hashlib.sha256(payload).hexdigest()]} if payload is not None else {}
        return pd.DataFrame({"file": rows["file"].iloc[:1], "at": rows["at"].iloc[:1]}).reset_index(drop=True).assign(**told or {"whole_payload_bytes": None, "whole_digest": None})

    return gathered.groupBy("file", "at").applyInPandas(whole, "file string, at long, whole_payload_bytes long, whole_digest string")


def resolved(records: DataFrame) -> DataFrame:
    """Records with the sizes of revisits taken from the responses they refer to."""
    stored = records.where("record_type = 'response'").groupBy(F.col("page").alias("refers"), "digest").agg(F.max("payload_bytes").alias("stored"))
    joined = records.join(stored, ["refers", "digest"], "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "stored")).drop("stored")


_ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
     f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= {MIN_REVISIT} GROUP BY digest)
SELECT page_id, size AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest
"""


@query("op6_warc", _ORACLE)
def op6_warc(spark, sf_dir):
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = resolved(read_warc(spark, path))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return records.select(
        number("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers").alias("refers_to")
    )
