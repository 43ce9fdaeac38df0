"""What the operators of this subpackage share: the shared folder, tables
written there, Arrow batches and dictionaries of tokens."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of an Arrow batch: some texts are very long, so few rows.
ARROW_ROWS = 500
#: A key that more rows than these have is a common one; where that would be more than COMMON_MOST keys, the count goes up.
COMMON, COMMON_MOST = 1000, 100_000
#: Tokens that a worker keeps; the table is emptied beyond it.
TOKENS_KEPT = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used in local mode (tests); on a
    cluster that would lose data, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stackfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/stackfield-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there,
    and a lost executor costs no more than the tasks that read it."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that saved() wrote and nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            if at.getName().startswith("stackfield-"):
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, tag: str, most: int) -> DataFrame:
    """df, written, and marked for broadcast if it has no more than `most` rows;
    with more of them the join that reads it shuffles."""
    df = saved(df, tag)
    return F.broadcast(df) if df.count() <= most else df


def joined(rows: DataFrame, facts: DataFrame, key: str, copies: str) -> DataFrame:
    """rows joined with facts, which have a row for each key; copies counts the
    rows with that key. Keys of more than COMMON rows, COMMON_MOST of them at
    most, are joined by broadcast, so that their rows stay where they are."""
    common = COMMON
    while facts.filter(F.col(copies) > common).count() > COMMON_MOST:
        common *= 8
    hot = F.broadcast(facts.filter(F.col(copies) > common))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.filter(F.col(copies) <= common), key)
    return rows.join(hot, key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow; f gets batches of at most `rows` rows. Spark bounds the bytes
    of what it sends (spark.sql.execution.arrow.maxBytesPerBatch)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)


def ascii_lower(col):
    """A-Z become a-z and nothing else changes; lower() suffices for pure ASCII."""
    return F.when(col.rlike("[^\\x00-\\x7F]"), F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(col))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Words(dict):
    """Token to the 64-bit hash of its letters and digits in lower case; 0 for
    a token without any. Each token is hashed once."""

    def __missing__(self, token: str) -> int:
        word = re.sub(r"[\W_]+", "", token.lower())
        h = self[token] = (xxhash.xxh64_intdigest(word) or 1) if word else 0
        return h

    def hashes(self, text: str) -> np.ndarray:
        if len(self) > TOKENS_KEPT:
            self.clear()
        w = np.array([self[t] for t in text.split()], dtype=np.uint64)
        return w[w != 0]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x affects every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(w: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct hashes, ascending, of runs of ``size`` words; a shorter text
    is one shingle, and a text without words has none."""
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    k = min(size, len(w))
    s = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        s = mixed(s * _MIX[j % 5] + w[j : j + n])
    return np.unique(s)
