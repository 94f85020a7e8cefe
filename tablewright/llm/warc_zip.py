"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads records without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.exact_dedup import tree_merge
from tablewright.llm.shared import buffers, shared_dir, small

ARCHIVE_BYTES = 8 << 20
"""Compressed bytes after which a task closes an archive and begins the next."""
DATE = "1970-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"

# Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    """A URL fit for a header line."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of ``refers_to`` that has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    block = head + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(raw: bytes) -> bytes:
    """One gzip member, the same for the same input."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members whose comment is the line feed that a text writer adds after it.

    ``zip64`` (or a size that needs it) writes the 64-bit fields and directory end.
    """
    out, central, count = [], [], len(members)
    at = 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        big = zip64 or max(len(data), at) >= FULL32
        short = FULL32 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        local = struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, short, short, len(raw), len(more), 0, 0, 0, 0, FULL32 if big else at) + raw + more)
        out += [local, data]
        at += len(local) + len(data)
    directory = b"".join(central)
    big = zip64 or at >= FULL32 or count >= FULL16
    tail = b""
    if big:
        tail = struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, len(directory), at) + struct.pack("<IIQI", LOCATOR64, 0, at + len(directory), 1)
    tail += struct.pack("<IHHHHIIH", END, 0, 0, FULL16 if big else count, FULL16 if big else count, FULL32 if big else len(directory), FULL32 if big else at, 1)
    return b"".join([*out, directory, tail])


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    at: int


class Archive:
    """The directory of a ZIP archive behind ``read_at(offset, length)``; records are read by range.

    Only the end of the file, the central directory, local heads, the index and the ranges asked for are read.
    """

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        span = min(size, 22 + FULL16)
        tail = read_at(size - span, span)
        at = len(tail) - 22
        while at >= 0:
            at = tail.rfind(struct.pack("<I", END), 0, at + 4)
            if at < 0 or len(tail) - at >= 22 and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22:
                break
            at -= 1
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        *_, count, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
        if FULL16 == count or FULL32 in (length, start):
            place = size - span + at - 20
            mark, _, end64, _ = struct.unpack("<IIQI", read_at(place, 20)) if place >= 0 else (0, 0, 0, 0)
            if mark == LOCATOR64:
                mark, *_, count, length, start = struct.unpack("<IQHHIIQQQQ", read_at(end64, 56))
                if mark != END64:
                    raise ValueError("no ZIP64 end of directory")
        self.members: dict[str, Member] = {}
        directory, at = read_at(start, length), 0
        for _ in range(count):
            head = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
            if head[0] != CENTRAL:
                raise ValueError("damaged ZIP directory")
            method, packed, whole, n, m, k, offset = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
            name = directory[at + 46 : at + 46 + n].decode()
            extra, place = directory[at + 46 + n : at + 46 + n + m], 0
            while place + 4 <= len(extra):
                kind, long = struct.unpack_from("<HH", extra, place)
                if kind == 1:
                    values = list(struct.unpack_from(f"<{long // 8}Q", extra, place + 4))
                    whole = values.pop(0) if whole == FULL32 else whole
                    packed = values.pop(0) if packed == FULL32 else packed
                    offset = values.pop(0) if offset == FULL32 else offset
                place += 4 + long
            self.members[name] = Member(name, method, packed, offset)
            at += 46 + n + m + k

    def start(self, name: str) -> int:
        """Where the data of a stored member begin."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is not stored but packed by method {member.method}")
        head = struct.unpack("<IHHHHHIIIHH", self.read_at(member.at, 30))
        if head[0] != LOCAL:
            raise ValueError(f"damaged local head of {name}")
        return member.at + 30 + head[9] + head[10]

    def range(self, name: str, offset: int, length: int) -> bytes:
        """Bytes of a stored member."""
        if offset < 0 or length < 0 or offset + length > self.members[name].size:
            raise ValueError(f"range outside {name}")
        return self.read_at(self.start(name) + offset, length)

    def index(self) -> Iterator[dict]:
        """The entries of all index members, in order; without any, every record found by walking the WARC members."""
        indexes = [n for n in self.members if n.startswith("indexes/") and n.endswith(".cdxj")]
        for name in indexes:
            for line in self.range(name, 0, self.members[name].size).decode().split("\n"):
                if line.strip():  # key, time, entry; keys hold no blanks
                    yield json.loads(line.split(" ", 2)[2])
        if not indexes:
            for name, member in self.members.items():
                at = 0
                while name.endswith(".warc.gz") and at < member.size:
                    opener, length = zlib.decompressobj(31), 0
                    while not opener.eof and at + length < member.size:
                        step = self.range(name, at + length, min(1 << 16, member.size - at - length))
                        opener.decompress(step)
                        length += len(step)
                    length -= len(opener.unused_data)
                    yield {"filename": name.removeprefix("archive/"), "offset": str(at), "length": str(length)}
                    at += length

    def records(self) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
        """(WARC head, HTTP head, payload) of every indexed record; head names in lower case."""
        for entry in self.index():
            raw = zlib.decompress(self.range("archive/" + entry["filename"], int(entry["offset"]), int(entry["length"])), 31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            warc = _fields(head)
            block = rest[: int(warc["content-length"])]
            http, _, payload = block.partition(b"\r\n\r\n")
            yield warc, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    rows = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in rows}


def package(rows: Iterator[tuple[int | None, str | None, bytes, str, int | None]], most: int = ARCHIVE_BYTES, zip64: bool = False) -> Iterator[bytes]:
    """Archives of the records of (page_id, url, payload, digest, refers_to) rows, each with an index; the final line feed is left to the writer."""
    body, lines, at = [], [], 0
    for page_id, url, payload, digest, refers_to in rows:
        packed = gzipped(record(page_id, url, payload, digest, refers_to))
        mime = "text/html" if refers_to is None else "warc/revisit"
        entry = {"url": _clean(url), "mime": mime, "digest": f"sha1:{digest}", "offset": str(at), "length": str(len(packed)), "filename": WARC_MEMBER.partition("/")[2]}
        lines.append(f"{_clean(url)} {DATE.translate(str.maketrans('', '', '-:TZ'))} {json.dumps(entry)}")
        body.append(packed)
        at += len(packed)
        if at >= most:
            yield zip_stored([(WARC_MEMBER, b"".join(body)), (INDEX_MEMBER, "\n".join(lines).encode())], zip64)
            body, lines, at = [], [], 0
    if body:
        yield zip_stored([(WARC_MEMBER, b"".join(body)), (INDEX_MEMBER, "\n".join(lines).encode())], zip64)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, most: int = ARCHIVE_BYTES, zip64: bool = False) -> None:
    """One record per row of ``pages`` into ZIP archives below ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest identifier becomes
    the response and the others revisit it; smaller payloads are all responses. Null payloads are empty,
    null URLs too; a row without identifier revisits like any other and is a response only among its
    like; repeated rows are written each. An empty table writes no archive. Spark's own writer commits
    the files, so a task that runs twice leaves one copy, and any file system serves: each archive is one
    row of a text file, whose final line feed is the archive's comment.
    """
    own = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("_payload"))
    keyed = own.withColumn("_key", F.unhex(F.sha1("_payload")))
    digests = keyed.select("_id", "_key", F.unhex(F.concat(F.md5("_payload"), F.lpad(F.hex(F.octet_length("_payload")), 16, "0"))).alias("_check"))
    answer = tree_merge(digests, "max").select(F.col("_id").alias("_own"), F.col("_key").alias("_digest"), "_keep").distinct()
    # only the revisits meet the payloads: a response needs no answer, and few revisits are broadcast, so that payloads stay where they are
    revisits = small(answer.filter(~F.col("_own").eqNullSafe(F.col("_keep"))), "revisits", most=100_000)
    refers = F.when(F.octet_length("_payload") >= least_bytes, F.col("_keep"))
    ready = keyed.join(revisits, (F.col("_key") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_own")), "left").select("_id", "_url", "_payload", "_key", refers.alias("_refers"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int | None, str | None, bytes, str, int | None]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    i, url, payload, key, refers_to = (c[k].as_py() for c in batch.columns)
                    yield i, url, payload, base64.b32encode(key).decode(), refers_to

        for archive in package(rows(), most, zip64):
            yield pa.record_batch([pa.array([archive], pa.binary())], names=["archive"])

    packed = ready.mapInArrow(work, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``.

    ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes`` and ``payload_digest`` (of the full
    payload: measured for responses, declared for revisits), ``digest_ok`` (null for revisits) and, if wanted,
    ``payload``. A record without identifier has a null ``page_id``; equal records are rows each, in no order; a folder
    without archives gives an empty result. A damaged archive stops the query with its path.

    Where ``path`` is a mounted folder (scheme ``file``), the directory, the index and each record are read by range and nothing else. Python can't
    open ranges of a store that only Spark's readers reach; there Spark hands over whole archives, which must be below 2 GB each.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok", *["payload"] * payloads]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), *[("payload", pa.binary())] * payloads])
    number = lambda said: int(said[10:-1]) if said and said[10:-1] else None

    def archives(batch: pa.RecordBatch) -> Iterator[tuple[str, Callable[[int, int], bytes], int]]:
        for k, (path, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if batch.num_columns == 2:
                with open("/" + path.removeprefix("file:").lstrip("/"), "rb", buffering=0) as file:
                    yield path, lambda at, n, number=file.fileno(): _read_range(number, at, n), length
            else:
                data, offsets = buffers(batch.column(2).slice(k, 1))
                yield path, lambda at, n, data=data: data[at : at + n].tobytes(), int(offsets[-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, read_at, length in archives(batch):
                out: list[tuple] = []
                held = 0
                try:
                    for warc, http, payload in Archive(read_at, length).records():
                        declared = warc["warc-payload-digest"].removeprefix("sha1:")
                        full = warc["warc-type"] != "revisit"
                        digest = base32_sha1(payload) if full else declared
                        row = (number(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-type"], number(warc.get("warc-refers-to")), len(payload) if full else int(http["content-length"]), digest, digest == declared if full else None)
                        out.append((*row, payload) if payloads else row)
                        held += len(payload) * payloads
                        if len(out) >= 2000 or held >= ARCHIVE_BYTES:
                            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], names=names)
                            out, held = [], 0
                except (ValueError, KeyError, IndexError, zlib.error, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                if out:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], names=names)

    mounted = path.startswith(("file:", "/"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "length", *["content"] * (not mounted))
    return files.mapInArrow(work, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean" + ", payload binary" * payloads)


def _read_range(file: int, at: int, n: int) -> bytes:
    """``n`` bytes at ``at``, less only at the end of the file."""
    parts = []
    while n > 0 and (part := os.pread(file, n, at)):
        parts.append(part)
        at, n = at + len(part), n - len(part)
    return b"".join(parts)


def op3_warc_zip(spark, sf_dir: str) -> DataFrame:
    """The contract's query: write all pages to archives in the shared folder and read them back."""
    path = shared_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
