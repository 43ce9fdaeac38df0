"""Dictionary-compressed WARC archives.

An archive begins with a skippable Zstandard frame that holds a dictionary
built from its own first records; each record is then a frame of its own,
compressed with that dictionary, so that records can be read one by one. The
first record is a warcinfo. Which rows are revisits follows from the digests of
payloads; those of common payloads leave theirs behind before rows are dealt to
the tasks, each of which writes one archive to the shared folder through
pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, saved, scratch

#: The skippable frame of a dictionary.
MAGIC = 0x184D2A5D
#: A dictionary's size, and the bytes of the archive's first records it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 * 1024, 1024 * 1024
LEVEL = 3
#: A payload that more rows than these have is a common one, and where that would be more than COMMON_MOST payloads, the count goes up.
COMMON, COMMON_MOST = 64, 100_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPACE = uuid.UUID("6f1f34e2-51ad-5d5c-9c3d-2f0c1c3f7a10")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*what: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ' '.join(map(str, what)))}>"


def _record(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(own_id: str, date: str) -> bytes:
    return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"software: stackfield\r\nformat: WARC File Format 1.1\r\n")


def record(own_id: str, date: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None = None, refers_id: str | None = None) -> bytes:
    """A response, or, without payload, a revisit that has only the HTTP head."""
    head = [f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
        head += [f"WARC-Refers-To: {refers_id}"] if refers_id else []
    return _record(head, HTTP + (payload or b""))


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from records; where they are too few to train one,
    their own first bytes serve."""
    sample = [r[i : i + 16384] for r in records for i in range(0, len(r), 16384)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES]


class Writer:
    """Writes one archive to a binary file. The first SAMPLE_BYTES of records
    wait until the dictionary is built from them."""

    def __init__(self, out):
        self.out, self.waiting, self.size, self.compressor = out, [], 0, None

    def add(self, rec: bytes) -> None:
        if self.compressor:
            self.out.write(self.compressor.compress(rec))
            return
        self.waiting.append(rec)
        self.size += len(rec)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        raw = build_dictionary(self.waiting)
        self.out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for rec in self.waiting:
            self.out.write(self.compressor.compress(rec))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._begin()


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, block) of each record, one frame at a time."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    raw = stream.read(n)
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest = b""
    while rest or (rest := stream.read(1 << 18)):
        one, parts = frames.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else stream.read(1 << 18)
            if not one.eof and not rest:
                raise ValueError("the archive ends within a record")
        rec = b"".join(parts)
        head, _, body = rec.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, body[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Write every row of pages as a record; returns (path, records), one row
    per archive, after the archives are written. records leaves the warcinfo out.

    Of rows with equal payloads of at least least_bytes, that with the largest
    page id is a response and the others revisit it; rows that share that id and
    payload are all responses, and revisits then name no record id; a payload
    whose ids are all null has only responses. Record ids are unique. date is the
    WARC-Date of all records, by default the time of the call. A null html is an
    empty payload, a null URL leaves its header out; an empty table gives no
    archive; further columns are ignored.
    """
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    ids = rows.filter(F.col("size") >= least_bytes).groupBy("sha1", "page_id").agg(F.count("*").alias("n"))
    top = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    last = ids.groupBy("sha1").agg(top.alias("top"), F.sum("n").alias("copies")).filter("copies > 1 AND top IS NOT NULL")
    last = saved(last.select("sha1", F.col("top.page_id").alias("last"), (F.col("top.n") == 1).alias("one"), "copies"), "payloads")
    common = COMMON
    while last.filter(F.col("copies") > common).count() > COMMON_MOST:
        common *= 8
    hot = last.filter(F.col("copies") > common).select("sha1", F.struct("last", "one").alias("hot"))
    # a common payload's rows are decided by a broadcast, of COMMON_MOST rows at most, and dealt by their number
    known = rows.join(F.broadcast(hot), "sha1", "left")
    revisit = F.col("hot").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot.last"))
    known = known.withColumn("payload", F.when(~revisit, F.col("payload"))).withColumn("key", F.when(F.col("hot").isNull(), F.col("sha1")).otherwise(F.monotonically_increasing_id().cast("string")))
    rest = last.filter(F.col("copies") <= common).select(F.col("sha1").alias("key"), F.struct("last", "one").alias("rest"))
    marked = known.join(rest.hint("merge"), "key", "left").select("page_id", "url", "payload", "size", "sha1", F.coalesce("hot", "rest").alias("at")).select("page_id", "url", "payload", "size", "sha1", "at.last", "at.one")
    folder = scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path = file_system(folder)
        at.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.warc.zst"
        n, writer, out = 0, None, None
        for b in batches:
            for page_id, url, payload, size, sha1, last, one in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    out = at.open_output_stream(name, compression=None)
                    writer = Writer(out)
                    writer.add(warcinfo(record_id(folder, part), date))
                named = record_id(folder, sha1, last) if one else None  # of the one response that others refer to
                own = named if named and page_id == last else record_id(folder, part, n)
                revisit = last is not None and last != page_id
                writer.add(record(own, date, page_id, url, None if revisit else payload, size, base64.b32encode(bytes.fromhex(sha1)).decode(), last, named))
                n += 1
        if writer:
            writer.close()
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return saved(arrow_map(marked, run, "path string, records long", 100), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Read the archives named by path: a row per record, page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload (null for a
    revisit). A response whose payload does not have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                at, path = file_system(uri)
                got, held = [], 0
                with at.open_input_stream(path, compression=None) as stream:
                    for head, block in read_archive(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        revisit, sha1 = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        if payload is not None and (digest(payload) != sha1 or len(payload) != int(head["X-Payload-Length"])):
                            raise ValueError(f"{head['WARC-Record-ID']} in {uri}: the payload is not the one written")
                        got.append((_int(head.get("X-Page-Id")), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), sha1, head["WARC-Type"], _int(head.get("X-Refers-To-Page-Id")), payload))
                        held += len(block)
                        if held > 1 << 23:
                            yield _batch(got)
                            got, held = [], 0
                if got:
                    yield _batch(got)

    return arrow_map(archives.select("path"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _batch(got: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*got), _RECORD, strict=True)], schema=_RECORD)
