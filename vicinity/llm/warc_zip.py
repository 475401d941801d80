"""Web archives in ZIP packages: written, and read by ranges without extraction.

A package is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`,
whose records are gzip members of their own, and `indexes/index.cdx`, a line per
record with its offset and length.  Every entry is written with ZIP64 sizes and the
file ends with a ZIP64 directory, so packages may exceed 4 GB.

The reader never extracts.  It reads the end of the file, finds the central
directory by the end record or its ZIP64 form, takes from it where the members lie,
reads the index by its range and then ranges of records, neighbours together.

The reader hashes each payload that it reads and fails where the digest or the size
in the headers is another; a revisit's are those of the response that it refers to.

Payloads are the pages' text in UTF-8; null is empty.  Of records with equal
payloads of at least `min_bytes` bytes the smallest id is a response, others are
revisits that refer to it and hold headers only.  Rows that repeat an id are records
of their own, each response or revisit by its own payload; with equal payloads all
rows of the smallest id are responses.  Rows with a null id are responses that no
revisit refers to, and are read back with a null id.  Extra columns are ignored, so
their names don't matter; an empty table gives an archive without packages.

Links of revisits are counted and broadcast up to BROADCAST_LINKS, so that payloads
stay where they are; more are joined, which shuffles payloads once.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import removed, shared_dir, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
BATCH = 4 << 20  # bytes of neighbouring records that one range read may take
BROADCAST_LINKS = 1_000_000  # of some 80 bytes


# --- writing -----------------------------------------------------------------

def warc_record(kind: str, uri: str, page_id: int | None, digest: str, length: int, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP headers and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{f'uuid:{uuid.uuid4()}' if page_id is None else f'page:{page_id}'}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ZipWriter:
    """Stored members, written front to back to a stream, with ZIP64 records."""

    def __init__(self, out):
        self.out, self.at, self.entries, self.member = out, 0, [], None

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        if self.member:
            self.member["crc"] = zlib.crc32(data, self.member["crc"])
            self.member["size"] += len(data)

    def open(self, name: str) -> None:
        raw = name.encode()
        head = self.at
        # sizes follow the data (bit 3), in 8 bytes each as the ZIP64 extra announces
        self.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.member = {"name": raw, "head": head, "crc": 0, "size": 0}

    def close_member(self) -> None:
        m, self.member = self.member, None
        self.write(struct.pack("<IIQQ", 0x08074B50, m["crc"], m["size"], m["size"]))
        self.entries.append(m)

    def finish(self) -> None:
        start = self.at
        for m in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["head"])
            self.write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, m["crc"], 0xFFFFFFFF, 0xFFFFFFFF, len(m["name"]), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + m["name"] + extra)
        size, end = self.at - start, self.at
        n = len(self.entries)
        self.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


# --- reading -----------------------------------------------------------------

def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: name -> (method, local header's offset, stored size).
    read(offset, length) gives bytes."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record = read(at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = read(start, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        packed, full, n, m, k = struct.unpack_from("<IIHHH", raw, at + 20)
        head = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n].decode()
        extra, e = raw[at + 46 + n : at + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, size_e = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # only the fields that are full in the entry, in this order
                wide = [*struct.unpack_from(f"<{size_e // 8}Q", extra, e + 4)]
                if full == 0xFFFFFFFF:
                    full = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if head == 0xFFFFFFFF:
                    head = wide.pop(0)
            e += 4 + size_e
        out[name] = (method, head, packed)
        at += 46 + n + m + k
    return out


def member_range(read, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes lie in the file."""
    method, head, size = entry
    if method:
        raise ValueError("only stored members can be read by ranges")
    local = read(head, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n, m = struct.unpack_from("<HH", local, 26)
    return head + 30 + n + m, size


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (lower-case names) and payload of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode().split("\r\n")[1:])
    block = block[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


def read_package(read, size: int):
    """Records of a package, in the order of its index."""
    members = directory(read, size)
    base, _ = member_range(read, members[ARCHIVE])
    at, length = member_range(read, members[INDEX])
    entries = [json.loads(x.split(" ", 2)[2]) for x in read(at, length).decode().splitlines()]
    k = 0
    while k < len(entries):
        first, stop = entries[k]["offset"], k
        while stop < len(entries) and entries[stop]["offset"] + entries[stop]["length"] - first <= max(BATCH, entries[k]["length"]):
            stop += 1
        last = entries[stop - 1]
        raw = read(base + first, last["offset"] + last["length"] - first)
        for e in entries[k:stop]:
            yield parse_record(gzip.decompress(raw[e["offset"] - first : e["offset"] - first + e["length"]]))
        k = stop


# --- Spark -------------------------------------------------------------------

def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def revisits(pages: DataFrame) -> DataFrame:
    """(id, digest, refers_to) of rows (id, digest, size) whose payload a row with a
    smaller id has."""
    rows = pages.where("id IS NOT NULL")
    first = rows.groupBy("digest", "size").agg(F.min("id").alias("refers_to"), F.max("id").alias("top")).where("top > refers_to").drop("top")
    return rows.join(first, ["digest", "size"]).where("id != refers_to").select("id", "digest", "refers_to").distinct()


def write_packages(pages: DataFrame, folder: str, id_col="page_id", uri_col="url", payload_col="html", min_bytes: int = 0) -> DataFrame:
    """Writes a package for each task below `folder` (a path that all executors share)
    and returns (path, records).  A package is written under a name of its attempt
    and then named in the result, so tasks may run again."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("payload", "utf-8"))))
    link = written(revisits(rows.select("id", "digest", F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes)))
    if link.count() <= BROADCAST_LINKS:
        link = F.broadcast(link)
    rows = rows.join(link, ["id", "digest"], "left").select("id", "uri", "payload", "digest", "refers_to")

    def run(batches):
        zip_, out, lines, path = None, None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                if zip_ is None:
                    path = f"{folder}/data-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
                    store, name = _file(path)
                    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(name)
                    zip_ = ZipWriter(out)
                    zip_.open(ARCHIVE)
                body = batch.column("payload")[i].as_buffer().to_pybytes()
                key, refers = batch.column("id")[i].as_py(), batch.column("refers_to")[i].as_py()
                digest = base64.b32encode(batch.column("digest")[i].as_py()).decode()
                uri = (batch.column("uri")[i].as_py() or "").replace("\r", "").replace("\n", "")
                raw = gzip.compress(warc_record("response" if refers is None else "revisit", uri, key, digest, len(body), body, refers), 1, mtime=0)
                at = zip_.member["size"]
                zip_.write(raw)
                lines.append(f"{uri.replace(' ', '%20')} 20240101000000 " + json.dumps({"offset": at, "length": len(raw), "digest": digest}))
        if zip_ is not None:
            zip_.close_member()
            zip_.open(INDEX)
            zip_.write("".join(x + "\n" for x in lines).encode())
            zip_.close_member()
            zip_.finish()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)], pa.int64())], ["path", "records"])

    made = rows.mapInArrow(run, "path string, records long")
    manifest = f"{folder}/manifest"
    made.write.parquet(manifest)  # names only the packages of attempts that ended well
    return pages.sparkSession.read.schema("path string, records long").parquet(manifest)


def read_packages(packages: DataFrame, path_col="path", with_payload: bool = False) -> DataFrame:
    """Records of the packages: page_id, uri, payload_bytes, payload_digest,
    record_type, refers_to, and with `with_payload` the payload (null in revisits)."""
    schema = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _file(path)
                with store.open_input_file(name) as f:
                    rows, held = [], 0
                    for warc, http, payload in read_package(lambda at, n: f.read_at(n, at), f.size()):
                        number = lambda key: int(warc[key].rsplit(":", 1)[1].rstrip(">")) if ":page:" in warc.get(key, "") else None  # noqa: B023, E731
                        revisit = warc["warc-type"] == "revisit"
                        size, digest = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (size, digest) != (own := (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())):
                            raise ValueError(f"{path}: record {warc['warc-record-id']} says {size} bytes, {digest}; its payload has {own}")
                        rows.append((number("warc-record-id"), warc["warc-target-uri"], size, digest, warc["warc-type"], number("warc-refers-to"), None if revisit else payload))
                        held += len(payload) if with_payload else 100
                        if held > BATCH:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                    yield _batch(rows, with_payload)

    def _batch(rows, full):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + full]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], [f.split(" ")[0] for f in schema.split(", ")])

    n = packages.count()
    return packages.select(path_col).repartition(max(1, n)).mapInArrow(run, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame, **how) -> DataFrame:
    """Writes pages as packages in the shared folder and reads their records back.  The
    packages, and what failed or doubled attempts left of others, go once the records
    are read."""
    folder = shared_dir(spark)
    records = written(read_packages(write_packages(pages, folder, **how)))
    removed(spark, folder)
    return records
