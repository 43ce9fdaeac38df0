"""Stacks: many frames of a capture become one.

Sums (mean, weighted mean, drizzle) are made in each partition over tiles of
TILE pixels, and the tiles' sums are then added up, so that a shuffle carries
one row for each tile and partition. Medians and clipped means need all values
of a pixel: frames are cut into tiles before the shuffle, and a task holds the
frames of one tile at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..frames import batched, images
from ..functions import kernels as K

#: Pixels of a tile of sums.
TILE = 65_536
#: Values that a task holds for a median or clipped mean, about.
HELD = 8_000_000
#: Captures whose sums a task keeps at a time; beyond it they are sent on.
KEPT = 16


def _key_fields(df: DataFrame, keys: tuple[str, ...]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def summed(frames: DataFrame, keys: tuple[str, ...], parts, names: tuple[str, ...], args: tuple[str, ...] = ()) -> DataFrame:
    """(keys, height, width, names as pixel arrays, n): the sums of parts(image, *args),
    which gives a two-dimensional array for each name."""
    fields = _key_fields(frames, keys)
    schema = T.StructType([*fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("tile", T.IntegerType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names), T.StructField("n", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        for (*key, h, w), (sums, n) in held.items():
            for t in range(0, h * w, TILE):
                row = [*key, h, w, t // TILE, *(s.ravel()[t : t + TILE] for s in sums), n]
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for a, *rest in zip(images(b, "pixels"), *(b.column(c).to_pylist() for c in (*args, *keys)), strict=True):
                made = parts(a, *rest[: len(args)])
                key = (*rest[len(args) :], *made[0].shape)
                if key in held:
                    held[key] = ([s + m for s, m in zip(held[key][0], made, strict=True)], held[key][1] + 1)
                else:
                    if len(held) >= KEPT:
                        yield from sent(held)
                        held = {}
                    held[key] = (list(made), 1)
        yield from sent(held)

    tiles = batched(frames.select(*keys, "height", "width", "pixels", *args)).mapInArrow(run, schema)

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = None, 0
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in names]
                sums = row if sums is None else [s + r for s, r in zip(sums, row, strict=True)]
                n += b.column("n")[i].as_py()
        row = [*(k.as_py() for k in key), *sums, n]
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    total = tiles.groupBy(*keys, "height", "width", "tile").applyInArrow(added, schema)
    return _joined(total, keys, names, F.max("n").alias("n"))


def _joined(tiles: DataFrame, keys: tuple[str, ...], names: tuple[str, ...], *more) -> DataFrame:
    """The tiles of each capture put together in their order; frames of a capture
    that differ in size are an error, and no frames are no row."""
    ends = [e(c).alias(f"__{e.__name__}_{c}") for c in ("height", "width") for e in (F.min, F.max)]
    whole = tiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tile", *names))).alias("t"), *ends, *more).filter(F.col("__max_height").isNotNull())
    alike = (F.col("__min_height") == F.col("__max_height")) & (F.col("__min_width") == F.col("__max_width"))
    sizes = [F.when(alike, F.col(f"__max_{c}")).otherwise(F.raise_error(F.lit("frames of a capture differ in size"))).cast("int").alias(c) for c in ("height", "width")]
    return whole.select(*keys, *sizes, *(F.flatten(F.col("t")[n]).alias(n) for n in names), *([F.col("n")] if more else []))


def mean_stack(frames: DataFrame, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(keys, height, width, pixels, n): the mean of each pixel. weight is a
    column of weights, of which negative ones count as 0; where their sum is
    below 1e-15 the mean is plain."""
    if weight is None:
        total = summed(frames, keys, lambda a: (a,), ("s",))
        return total.select(*keys, "height", "width", F.expr("transform(s, v -> v / n)").alias("pixels"), "n")
    weigh = lambda a, w: (a, a * max(w or 0.0, 0.0), np.full((a.shape[0], a.shape[1]), max(w or 0.0, 0.0)))
    total = summed(frames, keys, weigh, ("s", "sw", "w"), (weight,))
    return total.select(*keys, "height", "width", F.expr("if(w[0] >= 1e-15, transform(sw, v -> v / w[0]), transform(s, v -> v / n))").alias("pixels"), "n")


def drizzle_stack(frames: DataFrame, keys: tuple[str, ...] = (), scale: float = 2.0, pixfrac: float = 0.7, dy: str = "dy", dx: str = "dx", weight: str | None = None, sign: str = "compat") -> DataFrame:
    """(keys, height, width, pixels, n): each pixel's drop, laid on the finer grid.

    A frame's offset is subtracted; sign="corrected" adds it, which is right for
    offsets that warped() takes. Pixels of 0 add no weight; places without
    weight are 0.
    """
    if scale <= 0 or not 0 < pixfrac <= 1:
        raise ValueError("scale is above 0, and pixfrac above 0 and at most 1")
    turn = -1.0 if sign == "corrected" else 1.0
    lay = lambda a, y, x, *w: K.drizzled(a, turn * y, turn * x, scale, pixfrac, w[0] if w else 1.0)
    total = summed(frames, keys, lay, ("v", "w"), (dy, dx, *([weight] if weight else [])))
    pixels = F.expr("transform(arrays_zip(v, w), x -> least(greatest(if(x.w > 0, x.v / x.w, 0D), 0D), 1D))")
    return total.select(*keys, "height", "width", pixels.alias("pixels"), "n")


def tile_size(frames_per_capture: int) -> int:
    return int(min(TILE, max(1, HELD // max(1, frames_per_capture))))


def robust_stack(frames: DataFrame, method: str = "median", keys: tuple[str, ...] = (), sigma: float = 2.5, iterations: int = 2, tile: int | None = None) -> DataFrame:
    """(keys, height, width, pixels, n): the median, or the sigma-clipped mean, of each pixel.

    tile: pixels of a tile; unset, it follows from the largest capture, so that
    a task holds HELD values. median of an even number is the mean of the two in
    the middle.
    """
    if method not in ("median", "sigma_clip"):
        raise ValueError(f"unknown method {method!r}")
    if tile is None:
        most = frames.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
        tile = tile_size(most)
    cut = F.expr(f"transform(sequence(0, cast(ceil(size(pixels) / {tile}) as int) - 1), t -> named_struct('tile', t, 'v', slice(pixels, t * {tile} + 1, {tile})))")
    tiles = frames.select(*keys, "height", "width", F.inline(cut)).select(*keys, "height", "width", "tile", "v")
    schema = T.StructType([*_key_fields(frames, keys), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("tile", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def stacked(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.array([x.values.to_numpy(zero_copy_only=False) for b in batches for x in b.column("v")], dtype=np.float64)
        row = [*(k.as_py() for k in key), K.stacked(values, method, None, sigma, iterations), len(values)]
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    out = batched(tiles).groupBy(*keys, "height", "width", "tile").applyInArrow(stacked, schema)
    return _joined(out, keys, ("pixels",), F.max("n").alias("n"))
