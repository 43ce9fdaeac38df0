"""Kernels over frames: each row's pixels become an array, and what the kernel
returns becomes columns. Rows cross to Python in Arrow batches that Spark bounds
in bytes (spark.sql.execution.arrow.maxBytesPerBatch), as a frame can be large."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shipping import ship


def batched(df: DataFrame) -> DataFrame:
    """df, once the executors have this package."""
    ship(df.sparkSession)
    return df


def image(values, height: int, width: int) -> np.ndarray:
    return np.asarray(values, dtype=np.float64).reshape(height, width)


def images(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The two-dimensional arrays of a column of pixels."""
    column, heights, widths = batch.column(name), batch.column("height").to_pylist(), batch.column("width").to_pylist()
    for x, h, w in zip(column, heights, widths, strict=True):
        yield image(x.values.to_numpy(zero_copy_only=False), h, w)


def arguments(batch: pa.RecordBatch, name: str) -> list | Iterator[np.ndarray]:
    """The values of a column: arrays of floats as numpy arrays, others as they are in Python."""
    column = batch.column(name)
    if pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type) and not column.null_count:
        return (x.values.to_numpy(zero_copy_only=False) for x in column)
    return column.to_pylist()


def as_value(x):
    return x.astype(np.float32).ravel() if isinstance(x, np.ndarray) else x


def map_frames(frames: DataFrame, kernel: Callable, out: dict[str, str], pixels: tuple[str, ...] = ("pixels",), args: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """kernel(*images, *args) gives the values of the columns out, one value or a
    tuple; arrays become array<float>. args are columns, of which arrays of
    floats arrive as numpy arrays. Columns of out take the
    place of those of the same name; drop leaves columns out."""
    keep = [f for f in frames.schema if f.name not in out and f.name not in drop]
    made = [T.StructField(n, T._parse_datatype_string(t)) for n, t in out.items()]
    types = [to_arrow_type(f.dataType) for f in made]
    several = len(out) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(map(kernel, *(images(b, p) for p in pixels), *(arguments(b, a) for a in args)))
            rows = rows if several else [(x,) for x in rows]
            cols = [pa.array([as_value(r[i]) for r in rows], t) for i, t in enumerate(types)]
            yield pa.record_batch([*(b.column(f.name) for f in keep), *cols], names=[*(f.name for f in keep), *out])

    return batched(frames).mapInArrow(run, T.StructType([*keep, *made]))
