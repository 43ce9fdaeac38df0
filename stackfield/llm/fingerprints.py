"""Bottom-k sketches of documents.

A fingerprint is the k smallest of the 64-bit hashes of a text's distinct
five-word shingles, ascending, as base64 of big-endian numbers: equal texts
have equal fingerprints. Sketches merge by union, and estimate resemblance,
containment and the number of distinct shingles; a text with at most k shingles
is held exactly.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, shingles, shuffle_partitions

K = 128
#: Bytes of text of a range of rows, and ranges, at most; of larger tables the ranges are larger.
RANGE_BYTES, MOST_RANGES = 64 << 20, 10_000
#: Sketches that a task holds while it merges.
HELD = 20_000
_words = Words()


def sketch(text: str, k: int = K) -> np.ndarray:
    s = shingles(_words.hashes(text))
    return s[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of the union's k smallest that both have; 1 for two without shingles."""
    u = merge(a, b, k)
    if not len(u):
        return 1.0
    return float(np.isin(u, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(u))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has: among a's hashes that lie below the
    largest hash up to which b is known."""
    if not len(a):
        return 1.0
    known = a if len(b) < k else a[a <= b[-1]]
    return float(np.isin(known, b, assume_unique=True).mean()) if len(known) else 0.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[-1]) + 1) / 2.0**64)


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype=">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, shingles) of every row; shingles is the estimated
    number of distinct ones. A null text is empty, and an empty text has an
    empty fingerprint; a text of fewer than five words is one shingle; equal
    rows have equal fingerprints; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [sketch(t or "", k) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([to_text(x) for x in s]), pa.array([distinct(x, k) for x in s])], names=["doc_id", "fingerprint", "shingles"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fingerprint string, shingles double")


def edited(text: str, donor: str) -> str:
    """text, its last half replaced by the first as many code points of donor."""
    m = len(text) // 2
    return text[: len(text) - m] + donor[:m]


def merged(sketches: DataFrame, by: str, k: int = K) -> DataFrame:
    """The sketch of each value of the column `by` of sketches (by, fingerprint):
    by, fingerprint, shingles. Sketches are merged within each task before they
    are shuffled, so a value has at most one row for each task. A null value is
    one of its own, a null fingerprint is empty, an empty table gives no rows."""
    rows = sketches.select(F.col(by), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    schema = f"`{by}` {rows.schema[0].dataType.simpleString()}, fingerprint string"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for b in batches:
            kind = b.schema
            for v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[v] = merge(held[v], from_text(t), k) if v in held else from_text(t)
            if len(held) > HELD:
                yield _sketch_batch(held, kind)
                held = {}
        if held:
            yield _sketch_batch(held, kind)

    def whole(key: tuple, own: pa.Table) -> pa.Table:
        sketch = np.zeros(0, dtype=np.uint64)
        for t in own.column("fingerprint").to_pylist():
            sketch = merge(sketch, from_text(t), k)
        return pa.table({by: pa.array([key[0].as_py()], own.schema.field(by).type), "fingerprint": [to_text(sketch)], "shingles": [distinct(sketch, k)]})

    return arrow_map(rows, part, schema).groupBy(by).applyInArrow(whole, f"{schema}, shingles double")


def _sketch_batch(held: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), schema.field(0).type), pa.array([to_text(x) for x in held.values()])], names=schema.names)


def _ranges(rows: DataFrame, least: int) -> tuple[DataFrame, list[float], list[int], int]:
    """Ranges of rows (doc_id, text, h) in descending order of (doc_id, h), nulls
    last, of about RANGE_BYTES each or, of small tables, `least` of them.

    Cuts are approximate quantiles of ids, finer than the ranges, and an id that
    holds a quantile or more by itself is cut by h as well. Neighbours are joined
    until they hold their bytes, so a range's size follows from bytes, not rows.
    Returns (p, sub, r, guest_of, first_id, first_h) for each cut piece, the
    cuts, the ids that are cut by h, and into how many.
    """
    size, nulls, count = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("doc_id").isNull(), 1)), F.count("*")).first()
    parts = min(MOST_RANGES, max(least, math.ceil((size or 0) / RANGE_BYTES)))
    fine = 4 * parts
    found = rows.agg(F.percentile_approx("doc_id", [i / fine for i in range(1, fine)], 10 * fine)).first()[0] if fine > 1 else None
    repeats = Counter(found or ())
    hot = [i for i, n in repeats.items() if n > 1 and float(i) != float(i + 1) and float(i) != float(i - 1)]
    cuts = sorted({*map(float, repeats), *(float(i + 1) for i in hot)})
    hot = hot + [None] if count and nulls > count / fine else hot
    subs = parts if hot else 1
    placed = _placed(rows, cuts, hot, subs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "h"))
    pieces = sorted(placed.groupBy("p", "sub").agg(F.sum(F.octet_length("text") + 16).alias("size"), first.alias("first")).collect(), key=lambda x: (x["p"], x["sub"]))
    goal, ranges, held = sum(x["size"] for x in pieces) / parts, [], 0
    for x in pieces:
        if not ranges or held + x["size"] / 2 > goal:
            ranges.append([])
            held = 0
        ranges[-1].append(x)
        held += x["size"]
    out = []
    for r, own in enumerate(ranges):
        for i, x in enumerate(own):
            guest_of = (r - 1) % len(ranges) if i == 0 else None  # what follows a range's last row is the next range's first
            out.append((x["p"], x["sub"], r, guest_of, None if x["first"]["none"] else ~x["first"]["down"], x["first"]["h"]))
    spark = rows.sparkSession
    return spark.createDataFrame(out, "p int, sub int, r int, guest_of int, first_id long, first_h long"), cuts, hot, subs


def _placed(rows: DataFrame, cuts: list[float], hot: list[int | None], subs: int) -> DataFrame:
    """rows with p, which cuts the id lies between, in descending order, nulls
    last; and sub, of ids that are cut by h."""
    at = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__id", outputCol="__p", handleInvalid="keep") if cuts else None
    rows = rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    rows = at.transform(rows) if at else rows.withColumn("__p", F.lit(0.0))
    p = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - F.col("__p").cast("int"))
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    sub = F.least(F.floor(share * subs), F.lit(subs - 1)).cast("int")
    cut = F.col("doc_id").isin([i for i in hot if i is not None])
    cut = (cut | F.col("doc_id").isNull()) if None in hot else (cut & F.col("doc_id").isNotNull())
    return rows.withColumn("p", p).withColumn("sub", F.when(cut, sub).otherwise(0)).drop("__id", "__p")


def compare_edited(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every row, its text edited with the next document's (see
    edited), and that next document, in descending order of id; after the last
    comes the first.

    Rows are dealt by ranges of about equal bytes, once; each range also gets the
    row that follows its last one. doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (resemblances). A null text is
    empty; null ids come last; rows of equal ids stand in the order of their
    texts' hashes; a single row is its own next; an empty table gives no rows;
    further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranges, cuts, hot, subs = _ranges(rows, shuffle_partitions(docs.sparkSession))
    n = ranges.agg(F.max("r")).first()[0]
    own = _placed(rows, cuts, hot, subs).join(F.broadcast(ranges), ["p", "sub"])  # a row for each piece of a range: few for each task
    guest = F.when(F.col("guest_of").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), F.struct(F.col("guest_of").alias("r"), F.lit(True).alias("guest")))
    both = F.array_compact(F.array(F.struct("r", F.lit(False).alias("guest")), guest))
    dealt = own.select(F.explode(both).alias("x"), "doc_id", "h", "text").select("x.r", "x.guest", "doc_id", "h", "text")
    dealt = dealt.repartitionById((n or 0) + 1, F.col("r")).sortWithinPartitions("r", "guest", F.desc_nulls_last("doc_id"), "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of its range so far, with its sketch
        out: list[tuple] = []
        closed = None
        for b in batches:
            for p, guest, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if guest and p == closed:
                    continue  # of tied guests the first counts
                now = (p, doc_id, text, sketch(text, k))
                if held:
                    out.append(_compared(held, now, k))
                held = None if guest else now
                closed = p if guest else closed
            if out:
                yield _edited_batch(out)
                out = []

    return arrow_map(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", 200)


def _compared(row: tuple, after: tuple, k: int) -> tuple:
    _, doc_id, text, own = row
    new = edited(text, after[2])
    other = sketch(new, k)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), to_text(own), to_text(other), resemblance(own, other, k), resemblance(own, after[3], k)


_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edited_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _EDITED, strict=True)], schema=_EDITED)
