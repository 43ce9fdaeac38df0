"""N-gram Jaccard join by MinHash banding.

Equal word sequences are one class, and a representative of each goes on. Its
MinHash signature is cut into bands, whose number and rows are chosen for a
target recall at the threshold. Band hashes are shuffled, alone; texts that
share one are candidates of each other. A text's block is the most common
band hash among those of its candidates, so most candidates are in one block; a block of many texts, or
bytes, is split. A text goes to each pair of blocks that a band hash of its own,
or where that joins many blocks, of any text of its block, joins; there all pairs are verified at once on the full n-gram sets by a
product of incidence matrices: each pair in one place, whatever number of bands
it shares. A pair of blocks gives for each text the number of its links and one
link that spans, so a group of near copies costs no row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, joined, mixed, saved, shingles, shuffle_partitions, small
from .components import components

THRESHOLD, SHINGLE, RECALL = 0.8, 5, 0.999
#: Texts of a block, and their bytes, on average at most; a task holds two blocks' texts at a time.
BLOCK, BLOCK_BYTES = 128, 16 << 20
#: Blocks that a band hash joins, at most, for its own texts alone to meet; where it joins more, whole blocks meet.
FEW = 4
#: Columns of an incidence matrix at a time.
COLUMNS = 4096
#: Rows to drop that are broadcast as their numbers, 8 bytes each; beyond it the join shuffles.
GOES_BROADCAST = 500_000

_words = Words()


def bands_for(threshold: float, recall: float = RECALL, most_hashes: int = 144) -> tuple[int, int]:
    """(bands, rows): as many rows as possible, so as few chance candidates, such
    that a pair at the threshold shares a band with probability recall."""
    found = (1, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - p)))
        if bands * rows <= most_hashes:
            found = (bands, rows)
    return found


def _keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n], x[n:] | np.uint64(1)


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of the MinHash signature of the shingles s."""
    xor, mul = _keys(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, ((s[i : i + 2048, None] ^ xor) * mul).min(0), out=low)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        h = mixed(h * np.uint64(0xC2B2AE3D27D4EB4F) + low.reshape(bands, rows)[:, r])
    return h


def signed(docs: DataFrame, text_col: str, threshold: float, shingle: int) -> DataFrame:
    """docs with __row (its number), __sig (of its word sequence) and __bands
    (null without words), written to the shared folder."""
    bands, rows = bands_for(threshold)
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    at = numbered.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, hashes = [], []
            for t in b.column(at).to_pylist():
                w = _words.hashes(t or "")
                sigs.append(xxhash.xxh3_128_digest(w.tobytes()))
                hashes.append(band_hashes(shingles(w, shingle), bands, rows).view(np.int64) if len(w) else None)
            cols = [*b.columns, pa.array(sigs, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.record_batch(cols, names=[*b.schema.names, "__sig", "__bands"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return saved(arrow_map(numbered, run, f"{schema}, __sig binary, __bands array<bigint>"), "signed")


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of threshold or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(n), sizes)
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts > 1  # what one text alone has is in no intersection
    number = np.cumsum(keep) - 1
    mine = keep[at]
    who, at = who[mine], number[at[mine]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    common = np.zeros((n, n), dtype=np.float64)
    for lo in range(0, int(keep.sum()), COLUMNS):
        a, b = np.searchsorted(at, [lo, lo + COLUMNS])
        m = np.zeros((n, min(COLUMNS, int(keep.sum()) - lo)), dtype=np.float32)
        m[who[a:b], at[a:b] - lo] = 1
        common += m @ m.T
    joined = sizes[:, None] + sizes[None, :] - common
    out = common >= threshold * joined - 1e-9
    np.fill_diagonal(out, False)
    return out


def _spans(linked: np.ndarray, ids: list) -> list[int]:
    """For each text the place of the first, by ids, of those it is linked to by any path."""
    n, peer = len(ids), [-1] * len(ids)
    for i in sorted(range(n), key=lambda i: ids[i]):
        if peer[i] < 0:
            peer[i], todo = i, [i]
            while todo:
                for j in np.flatnonzero(linked[todo.pop()]):
                    if peer[j] < 0:
                        peer[j] = i
                        todo.append(int(j))
    return peer


def verified(members: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(rep, peer, links) from members (lo, hi, own, rep, doc_id, text): the texts
    of each pair of blocks against one another; own is a text's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for (lo, hi), group in groupby(rows, key=lambda r: r[:2]):
            group = list(group)
            linked = _links([shingles(_words.hashes(r[5]), shingle) for r in group], threshold)
            block = np.array([r[2] for r in group])
            if lo != hi:  # pairs within a block are counted where it meets itself
                linked &= block[:, None] != block[None, :]
            peers = _spans(linked, [(r[4] is None, r[4], r[3]) for r in group])
            counts = linked.sum(1)
            out += [(r[3], group[p][3], int(c)) for r, p, c in zip(group, peers, counts, strict=True) if c]
            if len(out) > 2000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["rep", "peer", "links"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["rep", "peer", "links"])

    return arrow_map(members, run, "rep long, peer long, links long", 100)


def _meetings(reps: DataFrame) -> DataFrame:
    """(rep, own, lo, hi): the pairs of blocks that each text of reps (rep, bytes, bands) goes to."""
    banded = reps.select("rep", F.explode("bands").alias("h"))
    common = banded.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    shared = saved(banded.join(common, "h"), "shared")
    # of the band hashes that a text shares the most common one, and of those the most common of all with whom it shares one
    own = shared.groupBy("rep").agg(F.max(F.struct("n", "h")).alias("best"))
    near = shared.join(own, "rep").groupBy("h").agg(F.max("best").alias("best"))
    keys = shared.join(saved(near, "near"), "h").groupBy("rep").agg(F.max("best")["h"].alias("key")).join(reps.select("rep", "bytes"), "rep")
    parts = keys.groupBy("key").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).alias("parts"))
    blocks = joined(keys, saved(parts, "blocks"), "key", "n").select("rep", F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("own"))
    blocks = saved(blocks, "placed")
    placed = saved(shared.select("rep", "h").join(blocks, "rep"), "placed")
    held = saved(placed.select("h", "own").distinct(), "held")
    over = held.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    other = saved(held.join(over, "h").select("h", F.col("own").alias("other"), "n"), "held")
    few = placed.join(other.filter(F.col("n") <= FEW), "h").select("rep", "own", "other")
    pairs = held.join(other.filter(F.col("n") > FEW), "h").select("own", "other").distinct()
    many = blocks.join(pairs, "own").select("rep", "own", "other")
    met = few.unionByName(many).filter("own <> other").unionByName(blocks.select("rep", "own", F.col("own").alias("other")))
    return met.select("rep", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).distinct()


def _grouped(docs: DataFrame, threshold: float, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and (__sig, class_id, class_row, copy_id, n_copies, n_links) of each class of copies."""
    spark = docs.sparkSession
    marked = signed(docs, text_col, threshold, shingle)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"))
    size = F.octet_length(text_col).cast("long")
    reps = marked.groupBy("__sig").agg(F.min(key).alias("k"), F.count("*").alias("n_copies"), F.first("__bands").alias("bands"), F.max(size).alias("bytes"))
    reps = saved(reps.select("__sig", F.col("k.doc_id").alias("copy_id"), F.col("k.row").alias("rep"), "n_copies", "bands", "bytes"), "classes")

    texts = marked.filter("__bands IS NOT NULL").select(F.col("__row").alias("rep"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    active = saved(_meetings(reps), "meetings").join(texts.hint("merge"), "rep")  # the texts cross a shuffle once, at every size alike
    parts = shuffle_partitions(spark)
    dealt = active.select("lo", "hi", "own", "rep", "doc_id", "text").repartition(parts, "lo", "hi").sortWithinPartitions("lo", "hi", "rep")
    found = saved(verified(dealt, threshold, shingle), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b"))).select(F.col("node").alias("rep"), "root")
    named = groups.join(reps.select("rep", F.struct(F.col("copy_id").isNull().alias("none"), F.col("copy_id").alias("doc_id"), F.col("rep").alias("row")).alias("k")), "rep")
    first = saved(named.groupBy("root").agg(F.min("k").alias("first"), F.count("*").alias("n")), "first")
    in_groups = joined(groups, first, "root", "n").select("rep", "first").join(links, "rep")
    classes = reps.join(in_groups, "rep", "left").select(
        "__sig", F.coalesce("first.doc_id", "copy_id").alias("class_id"), F.coalesce("first.row", "rep").alias("class_row"), "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    return marked, saved(classes, "named")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join texts whose sets of five-word shingles have a Jaccard similarity of
    threshold or more.

    One row per row of docs: doc_id; class_id, the least id of the texts that
    links join, by any path; copy_id, the least id of those with the same words;
    n_copies, the number of these; n_links, the number of different texts (each
    counted once, whatever its copies) that it is linked to.

    Words are runs without white space, in lower case and without signs. A text
    of fewer than five words is one shingle. Null and empty texts, and those
    without words, are copies of one another and have no links. Null ids come
    after all others; equal rows are copies; an empty table gives no rows;
    further columns are ignored.
    """
    marked, classes = _grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), threshold, shingle, "doc_id", "text")
    return joined(marked.select("doc_id", "__sig"), classes, "__sig", "n_copies").select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, without those that are a copy or near
    copy (by any path of links) of a row with a smaller id; texts without words
    all stay."""
    marked, classes = _grouped(docs, threshold, shingle, id_col, text_col)
    goes = joined(marked.filter("__bands IS NOT NULL").select("__row", "__sig"), classes.select("__sig", "class_row", "n_copies"), "__sig", "n_copies").filter("__row <> class_row").select("__row")
    return marked.join(small(goes, "goes", GOES_BROADCAST), "__row", "left_anti").drop("__row", "__sig", "__bands")
