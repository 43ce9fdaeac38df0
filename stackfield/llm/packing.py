"""Packing by concatenating and cutting.

Pass one turns each document into token ids, and writes them with the
document's start within its partition. The token totals of the partitions, one
number each, give by a prefix sum the start of every partition; start plus base
is a global offset. Pass two is a projection over the written table: the fixed
windows that a document's range of offsets meets are its pieces, and a piece
that ends at a window's edge is a boundary record. There is no shuffle of
tokens in either pass.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import attrgetter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENS_KEPT, arrow_map, saved

#: Totals of partitions joined by broadcast: 16 bytes each, so 16 MB at most.
TOTALS_BROADCAST = 1_000_000
#: Bytes of ids of a batch, or one document's.
MOST_BYTES = 1 << 28

#: The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for those from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([b for b in range(256) if b not in _VISIBLE], range(256, 512), strict=False))

#: Signs that are never part of a contraction or of a special token's end.
_SIGNS = ".,!?;:*#$%&)\"="


_ID = attrgetter("id")


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


class _Table:
    """The ids of tokens (what stands between ASCII white space): token number i
    has sizes[i] ids from starts[i] in flat. Token 0 is the end of a document."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([None], pa.string())
        self.flat = np.array([self.end_id], dtype=np.uint32)
        self.starts, self.sizes, self.seen = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), np.zeros(1, dtype=np.int32)

    def numbers(self, tokens: pa.Array) -> np.ndarray:
        """The number of each of the distinct tokens; new ones are learned."""
        at = pc.fill_null(pc.index_in(tokens, self.known, skip_nulls=True), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(self.known) + len(new) > TOKENS_KEPT and len(new) and len(self.known) > 1:
            self._forget()
            return self.numbers(tokens)
        if len(new):
            at[new] = len(self.known) + np.arange(len(new))
            self._learn(tokens.take(pa.array(new)))
        self.seen[at] += 1
        return at

    def _forget(self) -> None:
        """Keep the tokens of more than one batch, if they are few enough."""
        often = np.flatnonzero(self.seen > 1)
        known, flat, starts, sizes = self.known, self.flat, self.starts, self.sizes
        self._empty()
        if 0 < len(often) <= TOKENS_KEPT // 2:
            self._append(known.take(pa.array(often)), flat[_runs(starts[often], sizes[often])], sizes[often])

    def _append(self, tokens: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, tokens])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, ids])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.seen = np.concatenate([self.seen, np.zeros(len(sizes), dtype=np.int32)])

    def _learn(self, tokens: pa.Array) -> None:
        """Signs that end a token after a letter are cut off and encoded apart, as
        the vocabulary's own splitting does; so fewer bodies are new."""
        cut = pc.ascii_rtrim(tokens, _SIGNS).dictionary_encode()
        bodies, at = _strings(cut.dictionary), cut.indices.to_numpy().astype(np.int64)
        runs, letters, whole, texts, uncut = [], [], [], [], np.zeros(len(bodies), dtype=bool)
        for i, x in enumerate(bodies):
            low = x.lower()
            if x.isalpha() and (low.isascii() or (len(low) == len(x) and "ς" not in low and is_normalized("NFC", x))):
                # one run of letters: the normaliser and the splitting leave it whole, so the vocabulary's merges suffice
                runs.append(i)
                letters.append(low if low.isascii() else low.encode().decode("latin-1").translate(_BYTES))
            elif x and x[-1].lower()[-1].isalpha():
                whole.append(i)
                texts.append(x)
            else:
                uncut[i] = True
        tails, tail_at = {"": 0}, np.zeros(len(tokens), dtype=np.int64)
        signed = np.flatnonzero(pc.binary_length(tokens).to_numpy() > pc.binary_length(cut.dictionary).to_numpy()[at])
        for j, t in zip(signed, _strings(tokens.take(pa.array(signed))), strict=True):
            if not uncut[at[j]]:
                tail_at[j] = tails.setdefault(t[len(bodies[at[j]]) :], len(tails))
        odd = np.flatnonzero(uncut[at])
        at[odd] = len(bodies) + np.arange(len(odd))
        whole += at[odd].tolist()
        texts += _strings(tokens.take(pa.array(odd)))

        merged = list(map(self.tokenizer.model.tokenize, letters))
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([*texts, *tails], add_special_tokens=False)]
        flat = np.concatenate([np.fromiter(map(_ID, chain.from_iterable(merged)), np.uint32), np.fromiter(chain.from_iterable(encoded), np.uint32)])
        sizes = np.array([*map(len, merged), *map(len, encoded)], dtype=np.int64)
        slot = np.zeros(len(bodies) + len(odd), dtype=np.int64)
        slot[[*runs, *whole]] = np.arange(len(runs) + len(whole))
        both = np.stack([slot[at], tail_at + len(runs) + len(whole)], 1)
        self._append(tokens, flat[_runs((np.cumsum(sizes) - sizes)[both.ravel()], sizes[both.ravel()])], sizes[both].sum(1))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of sizes from starts, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_tables: dict[tuple[str, int], _Table] = {}


def encode(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts, each followed by end_id, in one array; and the
    number of ids of each. The vocabulary's tokens never span white space, so a
    text's ids are its tokens' ids joined; each distinct token is looked up once."""
    table = _tables.get((path, end_id)) or _tables.setdefault((path, end_id), _Table(path, end_id))
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    tokens = split.flatten().dictionary_encode()
    at = table.numbers(tokens.dictionary)[tokens.indices.to_numpy()]
    ends = np.cumsum(pc.list_value_length(split).to_numpy())
    at = np.insert(at, ends, 0)
    sizes = table.sizes[at]
    lengths = np.diff(np.cumsum(sizes)[ends + np.arange(len(ends))], prepend=0)
    return table.flat[_runs(table.starts[at], sizes)], lengths


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, part, start, n, ids): the ids of each row of docs (doc_id, text)
    and its start within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, n = encode(b.column(1), path, end_id)
            ends = np.cumsum(n)
            # offsets of 32 bits: a batch of huge texts is yielded in several
            for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(ends * 4 // MOST_BYTES, prepend=0))):
                if len(rows):
                    lo, hi = rows[0], rows[-1] + 1
                    first = int(ends[lo] - n[lo])
                    own = np.ascontiguousarray(ids[first : ends[hi - 1]])
                    offsets = np.concatenate([[0], (ends[lo:hi] - first) * 4]).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(own)])
                    yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array([part] * (hi - lo), pa.int32()), pa.array(at + ends[lo:hi] - n[lo:hi], pa.int64()), pa.array(n[lo:hi], pa.int64()), binary], names=["doc_id", "part", "start", "n", "ids"])
            at += int(ends[-1]) if len(ends) else 0

    return arrow_map(docs, run, "doc_id long, part int, start long, n long, ids binary")


def pack(docs: DataFrame, path: str, max_tokens: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every row of docs into sequences of max_tokens tokens.

    path: a tokenizer whose tokens do not span white space. One row per piece:
    doc_id, piece (from 0), start, length, doc_tokens, sequence_id, offset,
    cut_before, cut_after (whether the document goes on in the neighbouring
    sequence) and ids (little-endian unsigned 32-bit). Only the last sequence is
    not full.

    A null text is empty and has end_id alone; a null id stays null; equal rows
    are packed each for itself; an empty table gives no rows; further columns
    are ignored.
    """
    spark = docs.sparkSession
    wide = saved(tokenized(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path, end_id), "tokens")
    totals = sorted(wide.groupBy("part").agg(F.sum("n")).collect())
    bases = [(p, b) for (p, _), b in zip(totals, accumulate((n for _, n in totals), initial=0), strict=False)]
    base = spark.createDataFrame(bases, "part int, base long")
    base = F.broadcast(base) if len(bases) <= TOTALS_BROADCAST else base
    at, size = (F.col("base") + F.col("start")), F.lit(max_tokens).cast("long")

    def piece(s):
        lo = F.greatest(s * size, F.col("at")) - F.col("at")
        length = F.least((s + 1) * size, F.col("at") + F.col("n")) - F.col("at") - lo
        return F.struct(
            (s - F.expr(f"at div {max_tokens}")).cast("int").alias("piece"), lo.alias("start"), length.alias("length"), F.col("n").alias("doc_tokens"), s.alias("sequence_id"), (F.col("at") + lo - s * size).alias("offset"),
            (lo > 0).alias("cut_before"), (lo + length < F.col("n")).alias("cut_after"), F.substring(F.col("ids"), (lo * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
        )

    windows = F.sequence(F.expr(f"at div {max_tokens}"), F.expr(f"(at + n - 1) div {max_tokens}"))
    return wide.join(base, "part").select("doc_id", at.alias("at"), "n", "ids").select("doc_id", F.inline(F.transform(windows, piece)))


def sequences(pieces: DataFrame, max_tokens: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n, ids): the pieces of each sequence joined and padded to
    max_tokens; a sequence whose length is a power of two is left as it is."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate(F.col("p"), F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(max_tokens) - F.col("n")).cast("int")))
    return whole.select("sequence_id", "n", F.when(F.bit_count("n") == 1, joined).otherwise(F.concat(joined, pad)).alias("ids"))
