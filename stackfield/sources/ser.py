"""The SER video format as a Spark data source, "ser".

Reading: one partition for a range of frames, each frame read by its place in
the file; a filter on frame_index reaches the reader, which then reads no other
frames. Options: path; mode, mono (the default: the first or, of three planes,
the green one), colour (r, g, b; mosaics by method) or raw (the bytes of a
frame); method, bilinear or mhc; frames_per_partition. Writing: see write_ser.

Files are opened through pyarrow's file systems, so that a path can be a URI.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import FrameIndexOutOfRange, InvalidCrop, InvalidSource
from ..functions import kernels as K
from ..shipping import ship

MAGIC = b"LUCAM-RECORDER"
HEADER = struct.Struct("<14s7i40s40s40sQQ")
# Colour identifiers. Any other is mono.
COLOURS = {0: "mono", 8: "rggb", 9: "grbg", 10: "gbrg", 11: "bggr", 100: "rgb", 101: "bgr"}


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    pixel_depth: int
    frame_count: int
    colour_id: int = 0
    little_endian: bool = True
    observer: str | None = None
    instrument: str | None = None
    telescope: str | None = None
    date_time: int = 0
    date_time_utc: int = 0
    lu_id: int = 0

    @property
    def colour(self) -> str:
        return COLOURS.get(self.colour_id, "mono")

    @property
    def planes(self) -> int:
        return 3 if self.colour in ("rgb", "bgr") else 1

    @property
    def sample_bytes(self) -> int:
        return 1 if self.pixel_depth <= 8 else 2

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height * self.planes * self.sample_bytes

    def packed(self) -> bytes:
        text = lambda s: (s or "").encode()[:40].ljust(40, b"\0")
        return HEADER.pack(MAGIC, self.lu_id, self.colour_id, 0 if self.little_endian else 1, self.width, self.height, self.pixel_depth, self.frame_count, text(self.observer), text(self.instrument), text(self.telescope), self.date_time, self.date_time_utc)


def parse_header(raw: bytes) -> Header:
    """A flag of 1 means big-endian samples; anything else little-endian, as
    recorders write it in spite of the format's description."""
    if len(raw) < HEADER.size or not raw.startswith(MAGIC):
        raise InvalidSource("the file does not begin with a header of this format")
    _, lu, colour, endian, width, height, depth, count, *texts, local, utc = HEADER.unpack(raw[: HEADER.size])
    if width <= 0 or height <= 0:
        raise InvalidSource(f"frames of {width} by {height}")
    if not 1 <= depth <= 16:
        raise InvalidSource(f"a pixel depth of {depth} bits")
    if count < 0:
        raise InvalidSource(f"{count} frames")
    names = [t.split(b"\0", 1)[0].decode("utf-8", "replace").strip() or None for t in texts]
    return Header(width, height, depth, count, colour, endian != 1, *names, local, utc, lu)


def _opened(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(path)
    system, at = pafs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def read_header(path: str) -> Header:
    try:
        with _opened(path) as f:
            head, size = parse_header(f.read(HEADER.size)), f.size()
    except OSError as e:
        raise InvalidSource(f"{path} cannot be read: {e}") from e
    if size < HEADER.size + head.frame_count * head.frame_bytes:
        raise InvalidSource(f"{path} is shorter than its {head.frame_count} frames")
    return head


def decoded(raw: bytes, head: Header) -> np.ndarray:
    """(height, width, planes) of float32, by the depth's largest value."""
    kind = "u1" if head.sample_bytes == 1 else ("<u2" if head.little_endian else ">u2")
    values = np.frombuffer(raw, kind).astype(np.float32) / np.float32(2**head.pixel_depth - 1)
    return values.reshape(head.height, head.width, head.planes)


def as_colour(raw: bytes, head: Header, method: str = "bilinear") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = decoded(raw, head)
    if head.colour == "rgb":
        return a[..., 0], a[..., 1], a[..., 2]
    if head.colour == "bgr":
        return a[..., 2], a[..., 1], a[..., 0]
    if head.colour == "mono":
        raise InvalidSource("a mono source has no colour")
    return K.debayer(a[..., 0], head.colour, method)


def read_frame(path: str, index: int) -> bytes:
    head = read_header(path)
    if not 0 <= index < head.frame_count:
        raise FrameIndexOutOfRange(f"{index} of {head.frame_count} frames")
    with _opened(path) as f:
        return f.read_at(head.frame_bytes, HEADER.size + index * head.frame_bytes)


class Frames(InputPartition):
    def __init__(self, indices: list[int]):
        self.indices = indices


class SerReader(DataSourceReader):
    def __init__(self, path: str, head: Header, mode: str, method: str, per_partition: int):
        self.path, self.head, self.mode, self.method, self.per_partition = path, head, mode, method, per_partition
        self.low, self.high, self.only = 0, head.frame_count - 1, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("frame_index",):
                yield f
            elif isinstance(f, EqualTo):
                self._narrow({f.value})
            elif isinstance(f, In):
                self._narrow(set(f.value))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _narrow(self, values: set) -> None:
        self.only = values if self.only is None else self.only & values

    def partitions(self):
        span = range(self.low, self.high + 1)
        wanted = list(span) if self.only is None else sorted(i for i in self.only if i in span)
        return [Frames(wanted[i : i + self.per_partition]) for i in range(0, len(wanted), self.per_partition)] or [Frames([])]

    def read(self, partition) -> Iterator[tuple]:
        head = self.head
        end = HEADER.size + head.frame_count * head.frame_bytes
        with _opened(self.path) as f:
            stamped = f.size() >= end + 8 * head.frame_count
            for i in partition.indices:
                raw = f.read_at(head.frame_bytes, HEADER.size + i * head.frame_bytes)
                stamp = struct.unpack("<Q", f.read_at(8, end + 8 * i))[0] if stamped else None
                base = (i, head.height, head.width, 8 * head.sample_bytes, stamp)
                if self.mode == "raw":
                    yield (*base, raw)
                elif self.mode == "colour":
                    yield (*base, *(c.astype(np.float32).ravel().tolist() for c in as_colour(raw, head, self.method)))
                else:
                    yield (*base, decoded(raw, head)[..., 1 if head.planes == 3 else 0].ravel().tolist())


class SerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ser"

    def schema(self) -> str:
        last = {"raw": "raw binary", "colour": "r array<float>, g array<float>, b array<float>"}.get(self.options.get("mode", "mono"), "pixels array<float>")
        return f"frame_index long, height int, width int, bit_depth int, timestamp_us long, {last}"

    def reader(self, schema) -> SerReader:
        path, mode = self.options["path"], self.options.get("mode", "mono")
        if mode not in ("mono", "colour", "raw"):
            raise ValueError(f"unknown mode {mode!r}")
        head = read_header(path)
        each = max(1, 64_000_000 // head.frame_bytes)
        return SerReader(path, head, mode, self.options.get("method", "bilinear"), int(self.options.get("frames_per_partition", each)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SerSource)


def read_ser(spark: SparkSession, path: str, mode: str = "mono", **options) -> DataFrame:
    register(spark)
    return spark.read.format("ser").options(path=path, mode=mode, **{k: str(v) for k, v in options.items()}).load()


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row about the file."""
    h = read_header(path)
    row = (path, h.width, h.height, h.pixel_depth, h.frame_count, h.colour, h.planes, h.observer, h.instrument, h.telescope, h.frame_bytes * h.frame_count / 2**20)
    return spark.createDataFrame([row], "path string, width int, height int, pixel_depth int, frame_count int, colour string, planes int, observer string, instrument string, telescope string, size_mb double")


def write_ser(frames: DataFrame, path: str, head: Header, timestamps: bool = True) -> int:
    """Write frames (frame_index, raw, timestamp_us) as one file, in the order of
    frame_index; returns their number. Timestamps are written if every frame has one.

    The file is one stream: rows arrive partition after partition, sorted, and
    are written as they come.
    """
    ordered = frames.select("frame_index", "raw", "timestamp_us").orderBy("frame_index")
    counts = ordered.agg(F.count("*"), F.count("timestamp_us")).first()
    system, at = (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)
    stamps = []
    with system.open_output_stream(at, compression=None) as out:
        out.write(replace(head, frame_count=counts[0]).packed())
        for r in ordered.toLocalIterator():
            if len(r["raw"]) != head.frame_bytes:
                raise InvalidSource(f"frame {r['frame_index']} has {len(r['raw'])} bytes, not {head.frame_bytes}")
            out.write(bytes(r["raw"]))
            stamps.append(r["timestamp_us"])
        if timestamps and counts[0] and counts[0] == counts[1]:
            out.write(struct.pack(f"<{len(stamps)}Q", *stamps))
    return counts[0]


def crop_ser(spark: SparkSession, source: str, target: str, rect: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """Copy a rectangle of every frame, as bytes; returns the rectangle, even for a mosaic."""
    from ..operators.detect import validated_crop

    head = read_header(source)
    x, y, w, h = validated_crop(rect, head.width, head.height, head.colour in K.RED_AT)
    if not head.frame_count:
        raise InvalidCrop("there are no frames")
    each = head.planes * head.sample_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [np.frombuffer(r, np.uint8).reshape(head.height, head.width, each)[y : y + h, x : x + w].tobytes() for r in b.column("raw").to_pylist()]
            yield pa.record_batch([b.column("frame_index"), pa.array(raws, pa.binary()), b.column("timestamp_us")], names=["frame_index", "raw", "timestamp_us"])

    rows = read_ser(spark, source, "raw").mapInArrow(cut, "frame_index long, raw binary, timestamp_us long")
    write_ser(rows, target, replace(head, width=w, height=h))
    return x, y, w, h
