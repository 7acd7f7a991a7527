"""WARC archives with a two-level capture index.

``write_archive`` writes one record for each page, each its own gzip member, and an index: lines sorted by
reversed-host url key and cut into compressed blocks; every index file ends with a sparse directory, the
first key and place of each block. ``lookup`` finds the index files whose key range can hold a url (one
row for each file), reads the file's directory, binary-searches it, and reads only the blocks and then
the records in question by byte range.

Pages with equal payloads of ``least`` bytes or more are stored once: the one with the largest page
id is the response, the others are revisits that refer to it. Rows that share that largest id are all
responses, as are rows with null ids only.

Files are written by the tasks through Arrow's file systems into the folder that all executors share, under
names that no other attempt uses; the rows that name them are written as a table at once. A retried or
lost task leaves a file behind that no row names, and never a row without its file.

Null html counts as empty, null urls have the key ``-`` and no target header; control characters in urls
are percent-encoded in headers. Very long payloads are one record each. Repeated rows are records of their
own; an empty table gives an archive without files. Only the id, url and html columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import folder, stored, table
from ledgerlens.llm.url_rules import host_and_path
from ledgerlens.plans.registry import Query

#: Payloads of fewer bytes are always stored.
LEAST = 1000
BLOCK_LINES = 1000
#: A task starts a new archive file after so many bytes.
FILE_BYTES = 1 << 30
#: Records read by one task come from one stretch of so many bytes.
STRETCH = 64 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
#: placed after the directory: its length
_TAIL_BYTES = 8

CAPTURE = "key string, page_id bigint, file string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``, or ``-`` for null."""
    host, _ = host_and_path(url)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.regexp_replace(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", "")).otherwise(url)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit("-"))


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def record(page_id, url: str | None, kind: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; the payload of a revisit is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest)}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:uuid:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record_id(page_id, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}")


def parse(raw: bytes) -> dict:
    """Fields of one record, the digest and size taken from the payload where there is one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    page = fields.get("X-Page-ID", "").strip()
    strip = lambda x: x.removeprefix("<urn:uuid:").rstrip(">")
    return {
        "page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "record_id": strip(fields["WARC-Record-ID"]), "refers_to_id": strip(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
    }


def _write(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = out = name = None
        at = 0
        for b in batches:
            rows = []
            for key, page, url, payload, digest, response in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "url", "payload", "digest", "response")), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0])
                    out = system.open_output_stream(path, compression=None)
                kind = "response" if response is None or response == page else "revisit"
                refers = record_id(response, digest) if kind == "revisit" else None
                member = gzip.compress(record(page, url, kind, digest, payload, refers), LEVEL, mtime=0)
                out.write(member)
                rows.append((key, page, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CAPTURE_TYPES, strict=True)], _CAPTURE_NAMES)
        if out is not None:
            out.close()
    return run


_CAPTURE_NAMES = ["key", "page_id", "file", "offset", "length"]
_CAPTURE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _index(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{base}/{uuid.uuid4().hex}.cdx.gz"
        out, at, lines, directory, last = None, 0, [], [], None

        def flush():
            nonlocal at
            member = gzip.compress("".join(line for _, line in lines).encode(), LEVEL, mtime=0)
            directory.append((lines[0][0], at, len(member)))
            out.write(member)
            at += len(member)
            lines.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _CAPTURE_NAMES), strict=True):
                if out is None:
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0])
                    out = system.open_output_stream(path, compression=None)
                lines.append((row[0], json.dumps(row) + "\n"))
                last = row[0]
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        tail = gzip.compress(json.dumps(directory).encode(), LEVEL, mtime=0)
        out.write(tail + len(tail).to_bytes(_TAIL_BYTES, "little"))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([directory[0][0]]), pa.array([last]), pa.array([len(directory)], pa.int64())], ["index", "first", "last", "blocks"])
    return run


@dataclass(frozen=True)
class Archive:
    """``files``: one row for each index file (index, first, last, blocks)."""

    base: str
    files: DataFrame


def write_archive(pages: DataFrame, base: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> Archive:
    spark = pages.sparkSession
    base = base or folder(spark, "warc")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    responses = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # smaller payloads meet no response; keys of their own keep the many empty ones out of one task
    meets = F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()))
    planned = rows.withColumn("meets", meets).join(responses.withColumnRenamed("digest", "meets"), "meets", "left").withColumn("key", url_key(F.col("url")))
    captures = stored(planned.select("key", "page_id", "url", "payload", "digest", "response").mapInArrow(_write(f"{base}/warc"), CAPTURE), "captures")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = stored(ranged.mapInArrow(_index(f"{base}/index"), "index string, first string, last string, blocks bigint"), "index")
    return Archive(base, files)


#: Captures that a search holds before it hands them on.
FOUND = 10_000


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures of (index, key) rows, which come sorted: directory, binary search, block reads.

    A key with any number of captures is read block by block; a block and ``FOUND`` captures are held.
    """
    index = handle = firsts = directory = None
    block: tuple[int, list, list] = (-1, [], [])
    rows: list = []

    def found() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CAPTURE_TYPES, strict=True)], _CAPTURE_NAMES)
        rows.clear()
        return out

    for b in batches:
        for name, key in zip(b.column("index").to_pylist(), b.column("key").to_pylist(), strict=True):
            if name != index:
                system, path = _open(name)
                handle, index, block = system.open_input_file(path), name, (-1, [], [])
                size = handle.size()
                n = int.from_bytes(handle.read_at(_TAIL_BYTES, size - _TAIL_BYTES), "little")
                directory = json.loads(gzip.decompress(handle.read_at(n, size - _TAIL_BYTES - n)))
                firsts = [d[0] for d in directory]
            # a key can begin inside the block before the first that starts with it
            for i in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                if block[0] != i:
                    lines = gzip.decompress(handle.read_at(directory[i][2], directory[i][1])).decode().splitlines()
                    captures = [json.loads(x) for x in lines]
                    block = (i, captures, [c[0] for c in captures])
                rows.extend(block[1][bisect_left(block[2], key):bisect_right(block[2], key)])
                if len(rows) >= FOUND:
                    yield found()
    if rows:
        yield found()


def lookup(archive: Archive, keys: DataFrame, key: str = "key") -> DataFrame:
    """Captures (key, page_id, file, offset, length) of the distinct url keys of ``keys``."""
    spark = keys.sparkSession
    ranges = sorted((r["first"], r["last"], r["index"]) for r in archive.files.collect())  # one for each index file
    firsts, lasts, names = ([r[i] for r in ranges] for i in range(3))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(names[i], k) for k in b.column("key").to_pylist() for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["index", "key"])

    wanted = keys.select(F.col(key).alias("key")).where("key is not null").distinct().mapInArrow(reached, "index string, key string")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return wanted.repartition(parts, "index").sortWithinPartitions("index", "key").mapInArrow(_search, CAPTURE)


RECORD = "page_id bigint, url string, record_type string, record_id string, refers_to_id string, payload_bytes bigint, payload_digest string, payload binary"


def _fetch(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = handle = None
        for b in batches:
            found = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    system, path = _open(file)
                    handle, name = system.open_input_file(path), file
                r = parse(zlib.decompress(handle.read_at(length, offset), 31))
                r["payload_bytes"] = None if r["payload"] is None else len(r["payload"])
                found.append(r if with_payload else r | {"payload": None})
            if found:
                yield pa.RecordBatch.from_pylist(found, _RECORD_SCHEMA)
    return run


_RECORD_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def fetch(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ``captures``, read by byte range; a task reads one stretch of a file in order."""
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stretch = F.floor(F.col("offset") / STRETCH)
    spread = captures.select("file", "offset", "length").repartition(parts, "file", stretch).sortWithinPartitions("file", "offset")
    return spread.mapInArrow(_fetch(with_payload), RECORD)


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archive gives it back; revisits are resolved through their response."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = write_archive(pages)
    records = stored(fetch(lookup(archive, pages.select(url_key(F.col("url")).alias("key"))), with_payload=False).drop("payload"), "records")
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("stored_bytes"))
    revisits = records.join(responses, "refers_to_id", "left")
    return revisits.select(
        "page_id", F.coalesce("payload_bytes", "stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes, url from pages),
w as (select payload_digest, max(page_id) as response from p where payload_bytes >= {LEAST} group by 1)
select page_id, payload_bytes, payload_digest, case when response is null or response = page_id then 'response' else 'revisit' end as record_type,
       case when response <> page_id then response end as refers_to, url
from p left join w using (payload_digest)
"""

QUERIES = {"op8_capture_index": Query(archived_pages, ORACLE)}
