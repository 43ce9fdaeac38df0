"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ten words (a shorter item is one window); a
window is the set of its five-word shingles. One pass over the documents finds
the places of shingles that any item has, and counts them: that is the order by
rarity. A document can hold a window only if it holds the window's rarest
shingle (the necessary prefix at full containment), so only that shingle is
joined; the place of the shingle gives the one place where the window could
begin and end (the positional and length bounds), and the words there are
compared. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Item shingles tested in one set; more are tested in several sets.
SET_SIZE = 20_000
#: Distinct item shingles that are tested in the plan, 8 bytes each; beyond it the places of shingles are joined with a table of them.
SHINGLES_IN_PLAN = 200_000
#: Shingles of that table broadcast up to this count (16 bytes each); beyond it the join shuffles.
SHINGLES_BROADCAST = 2_000_000
#: Windows broadcast up to this count (about 200 bytes each); beyond it the join shuffles.
WINDOWS_BROADCAST = 100_000
#: Digests of contaminated texts broadcast up to this count (32 bytes each); beyond it the join shuffles.
TEXTS_BROADCAST = 300_000


def words(col):
    return F.regexp_extract_all(ascii_lower(F.coalesce(col, F.lit(""))), F.lit(WORD), F.lit(0))


def _hash(w: str, at: str, k: int) -> str:
    return "xxhash64(" + ", ".join(f"{w}[{at} + {j}]" for j in range(k)) + ")"


def _starts(k: int) -> str:
    """The places of shingles of k words in the words w."""
    return f"if(size(w) >= {k}, sequence(0, size(w) - {k}), array())"


def _places_in(k: int, hashes: list[int]) -> str:
    """The places of shingles of k words that have one of the hashes."""
    tests = " OR ".join(f"{_hash('w', 'i', k)} IN ({', '.join(f'{h}L' for h in hashes[a : a + SET_SIZE])})" for a in range(0, len(hashes), SET_SIZE))
    return f"filter({_starts(k)}, i -> {tests})"


def _windows(bench: DataFrame, window: int, shingle: int) -> DataFrame:
    """(w, m, k, items): the distinct windows, their words, shingle length and items."""
    items = bench.select("item_id", words(F.col("text")).alias("iw")).filter("size(iw) > 0")
    cut = F.expr(f"transform(sequence(0, greatest(0, size(iw) - {window})), i -> slice(iw, i + 1, {window}))")
    each = items.select("item_id", F.explode(cut).alias("w"))
    return each.groupBy("w").agg(F.collect_set("item_id").alias("items")).select("w", F.size("w").alias("m"), F.least(F.size("w"), F.lit(shingle)).alias("k"), "items")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hold every row of docs against every row of bench (item_id, text).

    One row per row of docs: doc_id, n_words, n_hit (words inside an occurrence
    of a window), n_items, item_ids (as strings, sorted), contaminated (n_hit >
    0). A null or empty text has no words and is clean; a null item id counts as
    the empty string; an item without words has no window; equal documents each
    get a row, equal items count by their ids; with an empty bench all documents
    are clean; further columns are ignored.
    """
    if window < shingle:
        raise ValueError("a window has at least as many words as a shingle")
    bench = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = saved(_windows(bench, window, shingle), "windows")
    each = windows.select("k", F.explode(F.array_distinct(_shingle_hashes())).alias("h")).distinct()
    back, span = window - shingle, 2 * window - shingle  # a shingle stands at most `back` words into its window
    place = lambda k, h, i: f"named_struct('k', {k}, 'h', {h}, 'pos', {i}, 'base', greatest({i} - {back}, 0), 'near', slice(w, greatest({i} - {back}, 0) + 1, {span}))"
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    few = each.limit(SHINGLES_IN_PLAN + 1).collect()
    if len(few) <= SHINGLES_IN_PLAN:
        wanted: dict[int, list[int]] = {}
        for k, h in few:
            wanted.setdefault(k, []).append(h)
        found = [F.expr(f"transform({_places_in(k, sorted(hashes))}, i -> {place(k, _hash('w', 'i', k), 'i')})") for k, hashes in sorted(wanted.items())]
        empty = F.expr("cast(array() as array<struct<k: int, h: bigint, pos: int, base: int, near: array<string>>>)")
        places = base.select("row", "doc_id", "w", (F.concat(*found) if found else empty).alias("found"))
    else:
        base = saved(base, "words")
        ks = [r["k"] for r in windows.select("k").distinct().collect()]  # 1 to shingle
        made = [F.expr(f"transform({_starts(k)}, i -> named_struct('k', {k}, 'h', {_hash('w', 'i', k)}, 'pos', i))") for k in sorted(ks)]
        spots = base.select("row", F.explode(F.concat(*made)).alias("s")).select("row", "s.*").join(small(each, "shingles", SHINGLES_BROADCAST), ["k", "h"], "left_semi")
        own = spots.groupBy("row").agg(F.collect_list(F.struct("k", "h", "pos")).alias("own"))  # of one document
        made = F.expr(f"transform(coalesce(own, array()), s -> {place('s.k', 's.h', 's.pos')})")
        places = base.join(own, "row", "left").select("row", "doc_id", "w", made.alias("found"))
    scan = saved(places.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "found"), "scan")

    rarity = scan.select(F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["k"].alias("k"), x["h"].alias("h"))))).alias("s")).groupBy("s.k", "s.h").count()
    spots = windows.select("w", "m", "k", "items", F.posexplode(_shingle_hashes()).alias("off", "h"))
    first = spots.join(rarity, ["k", "h"], "left").groupBy("w", "m", "k", "items").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "off", "h")).alias("p"))
    prefix = first.select("k", F.col("p.h").alias("h"), F.col("p.off").alias("off"), "m", F.col("w").alias("words"), "items")
    prefix = F.broadcast(prefix) if windows.count() <= WINDOWS_BROADCAST else prefix

    cand = scan.select("row", "doc_id", "n_words", F.explode_outer("found").alias("c")).select("row", "doc_id", "n_words", "c.*")
    start = F.col("pos") - F.col("off")
    same = (start >= 0) & (start + F.col("m") <= F.col("n_words")) & (F.slice("near", start - F.col("base") + 1, F.col("m")) == F.col("words"))
    # start below base would be a negative place in `near`; back covers every offset, so it is only below 0 with start
    met = cand.join(prefix, ["k", "h"], "left").withColumn("same", F.when(start >= 0, same))
    hits = met.groupBy("row", "doc_id", "n_words").agg(F.collect_set(F.when(F.col("same"), F.struct(start.alias("s"), F.col("m").alias("m")))).alias("at"), F.collect_set(F.when(F.col("same"), F.col("items"))).alias("items"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["s"], x["s"] + x["m"] - 1))))).cast("long")
    ids = F.array_sort(F.array_distinct(F.flatten("items")))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that are not contaminated. Whether one
    is depends on its text alone, so a digest of the text names it."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    found = decontaminate(docs.select(digest.alias("digest"), F.col(text_col).alias("text")), bench, window, shingle, "digest", "text")
    goes = small(found.filter("contaminated").select(F.col("doc_id").alias("__digest")).distinct(), "goes", TEXTS_BROADCAST)
    return docs.withColumn("__digest", digest).join(goes, "__digest", "left_anti").drop("__digest")


def _shingle_hashes():
    """Of a window's words w: the hash of each of its shingles of k words."""
    by_k = lambda k: f"transform(sequence(0, m - {k}), i -> {_hash('w', 'i', k)})"
    return F.expr("CASE k " + " ".join(f"WHEN {k} THEN {by_k(k)}" for k in range(1, 10)) + " END")
