"""The tables of a capture, and the ways between them.

frames: frame_index, height, width, pixels (or r, g, b for colour), and any
columns besides, such as the capture a frame belongs to. pixels: one row per
pixel, with r, c and v. Pixels are row-major.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = T.StructType([T.StructField("frame_index", T.LongType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("bit_depth", T.IntegerType()), T.StructField("timestamp_us", T.LongType()), T.StructField("pixels", T.ArrayType(T.FloatType()))])
COLOUR = T.StructType([*FRAMES.fields[:-1], *(T.StructField(c, T.ArrayType(T.FloatType())) for c in "rgb")])
DETECTION = "struct<cx: double, cy: double, bbox_width: int, bbox_height: int, area: long>"


def to_pixels(frames: DataFrame, *keys: str, column: str = "pixels") -> DataFrame:
    """keys, r, c, v: one row per pixel."""
    wide = frames.select(*keys, "width", F.posexplode(column).alias("pos", "v"))
    return wide.select(*keys, F.floor(F.col("pos") / F.col("width")).cast("int").alias("r"), (F.col("pos") % F.col("width")).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def to_frames(pixels: DataFrame, *keys: str, column: str = "pixels") -> DataFrame:
    """The frames that rows of keys, r, c, v make up; all pixels of a frame must be there."""
    lines = F.array_sort(F.collect_list(F.struct("r", "c", "v")))
    return pixels.groupBy(*keys).agg((F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width"), F.transform(lines, lambda x: x["v"]).alias(column))


def interleaved_to_planes(frames: DataFrame, column: str = "pixels") -> DataFrame:
    """r, g, b in the place of interleaved pixels of three values each; width is then a third."""
    plane = lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.size(column) / 3).cast("int") - 1), lambda i: F.get(F.col(column), i * 3 + k))
    return frames.select(*(c for c in frames.columns if c not in (column, "width")), F.floor(F.col("width") / 3).cast("int").alias("width"), *(plane(k).alias(n) for k, n in enumerate("rgb")))


def planes_to_interleaved(frames: DataFrame, column: str = "pixels") -> DataFrame:
    whole = F.flatten(F.transform(F.arrays_zip("r", "g", "b"), lambda x: F.array(x["r"], x["g"], x["b"])))
    return frames.select(*(c for c in frames.columns if c not in ("r", "g", "b", "width")), (F.col("width") * 3).alias("width"), whole.alias(column))
