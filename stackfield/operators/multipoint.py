"""Stacks with local alignment: alignment points, and surfaces warped between them.

Offsets, the mean reference and the grid of each capture come first, as tables:
a row for each capture, as large as one frame; for colour, those of the luminance. Search squares are cut out of
the frames before the shuffle, so that a frame crosses it once for each point
that selected it, and only that square of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import EmptySequence, PipelineError
from ..frames import batched, map_frames
from ..functions import kernels as K
from . import align, filters, quality, stack

REFERENCE_SHARE = 0.2
#: Stands in the place of a frame's index where a square is one of the reference.
OF_REFERENCE = -1
_PLACE = "ap_index: int, cy: int, cx: int"


def _first(frames: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return frames.filter("frame_index = 0").select(*keys, "pixels")


def global_offsets(frames: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, frame_index, dy, dx) by phase correlation with frame 0 of the capture, whose own is 0."""
    found = align.offsets(frames, _first(frames, keys), keys)
    own = F.col("frame_index") == 0
    return found.select(*keys, "frame_index", F.when(own, 0.0).otherwise(F.col("dy")).alias("dy"), F.when(own, 0.0).otherwise(F.col("dx")).alias("dx"))


def mean_reference(frames: DataFrame, offsets: DataFrame, metric: str = "laplacian", share: float = REFERENCE_SHARE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, height, width, pixels): the mean of the best share of each capture's frames, each moved by its offset."""
    best = quality.select_fraction(quality.score_frames(frames, metric, keys), share, keys).select(*keys, "frame_index")
    moved = align.shift(frames.join(best, [*keys, "frame_index"], "left_semi").join(offsets, [*keys, "frame_index"]))
    mean = stack.mean_stack(moved.select(*keys, "frame_index", "height", "width", "pixels"), keys)
    return mean.select(*keys, "height", "width", F.col("pixels").cast("array<float>").alias("pixels"))


def _prepared(frames: DataFrame, metric: str, ap_size: int, min_brightness: float, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The offsets, and (keys, height, width, pixels, aps): the reference of each capture and its points."""
    offsets = global_offsets(frames, keys).persist()
    points = lambda a: [{"ap_index": i, "cy": y, "cx": x} for i, y, x in K.ap_grid(a, ap_size, min_brightness)]
    reference = map_frames(mean_reference(frames, offsets, metric, keys=keys), points, {"aps": f"array<struct<{_PLACE}>>"}).persist()
    captures, without = reference.agg(F.count("*"), F.count_if(F.size("aps") == 0)).first()
    if not captures:
        raise EmptySequence("there are no frames to stack")
    if without:
        raise PipelineError("no alignment points: the image is too dark or too small" + (f" ({without} of {captures} captures)" if keys else ""))
    return offsets, reference


def ap_scores(frames: DataFrame, offsets: DataFrame, reference: DataFrame, ap_size: int, metric: str = "laplacian", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, frame_index, ap_index, cy, cx, score): each frame is read once, for all points (aps of reference)."""
    half = ap_size // 2

    def kernel(a, aps, dy, dx):
        return [{**p, "score": K.quality(K.region_shifted(a, p["cy"], p["cx"], half, dy, dx), metric)} for p in aps]

    slim = align.with_reference(frames.select(*keys, "frame_index", "height", "width", "pixels"), reference, keys, ("aps",)).join(offsets, [*keys, "frame_index"])
    out = map_frames(slim, kernel, {"found": f"array<struct<{_PLACE}, score: double>>"}, args=("ref_aps", "dy", "dx"), drop=("height", "width", "pixels", "ref_aps", "dy", "dx"))
    return out.select(*keys, "frame_index", F.inline("found"))


def multi_point_stack(frames: DataFrame, ap_size: int = 64, search_radius: int = 16, select: float = 0.25, min_brightness: float = 0.05, metric: str = "laplacian", local: str = "mean", sigma: float = 2.5, iterations: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (keys, height, width, pixels) for each capture, from its frames, indices from 0 in each."""
    offsets, reference = _prepared(frames, metric, ap_size, min_brightness, keys)
    half = ap_size // 2
    search = half + search_radius
    chosen = quality.select_fraction(ap_scores(frames, offsets, reference, ap_size, metric, keys), select, (*keys, "ap_index"))
    wanted = chosen.groupBy(*keys, "frame_index").agg(F.collect_list(F.struct("ap_index", "cy", "cx", "score")).alias("aps"))
    slim = frames.select(*keys, "frame_index", "height", "width", "pixels").join(wanted, [*keys, "frame_index"]).join(offsets, [*keys, "frame_index"])

    def squares(a, aps, dy, dx):
        return [{**x, "square": K.region_shifted(a, x["cy"], x["cx"], search, dy, dx).astype(np.float32).ravel()} for x in aps]

    def known_squares(a, aps):
        return [{**x, "score": 0.0, "square": K.region(a, x["cy"], x["cx"], search).astype(np.float32).ravel()} for x in aps]

    found = {"found": f"array<struct<{_PLACE}, score: double, square: array<float>>>"}
    cut = map_frames(slim, squares, found, args=("aps", "dy", "dx"), drop=("pixels", "aps", "dy", "dx"))
    own = map_frames(reference.withColumn("frame_index", F.lit(OF_REFERENCE).cast("long")), known_squares, found, args=("aps",), drop=("pixels", "aps"))
    cut = cut.unionByName(own).select(*keys, "frame_index", "height", "width", F.inline("found"))
    schema = T.StructType([*(cut.schema[k] for k in (*keys, "height", "width", "ap_index", "cy", "cx")), T.StructField("patch", T.ArrayType(T.DoubleType()))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def local_stack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patches, weights, rows = [], [], []
        for b in batches:
            for i, s, x, *place in zip(b.column("frame_index").to_pylist(), b.column("score").to_pylist(), b.column("square"), *(b.column(c).to_pylist() for c in ("height", "width", "cy", "cx")), strict=True):
                square = x.values.to_numpy(zero_copy_only=False)
                if i == OF_REFERENCE:
                    known, (h, w, cy, cx) = square.astype(np.float64).reshape(2 * search, 2 * search), place
                else:
                    rows.append((i, s, square))
        for _, score, square in sorted(rows, key=lambda r: (-r[1], r[0])):
            patch = K.local_patch(known, square.astype(np.float64).reshape(2 * search, 2 * search), half)
            if patch is not None:
                patches.append(patch)
                weights.append(score)
        if patches:
            out = K.stacked(np.array(patches), local, np.array(weights), sigma, iterations)
        else:
            out = known[search - half : search + half, search - half : search + half]
        row = [*(k.as_py() for k in key[:-1]), h, w, key[-1].as_py(), cy, cx, out.ravel()]
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    stacks = batched(cut).groupBy(*keys, "ap_index").applyInArrow(local_stack, schema)
    return blend(stacks, ap_size, keys)


def multi_point_stack_colour(frames: DataFrame, ap_size: int = 64, search_radius: int = 16, select: float = 0.25, min_brightness: float = 0.05, metric: str = "laplacian", local: str = "mean", sigma: float = 2.5, iterations: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (keys, height, width, r, g, b) for each capture. Offsets,
    reference, points, scores and local matches are of the luminance; each
    channel is then sampled once, at the place that they say."""
    grey = filters.luminance(frames)
    offsets, reference = _prepared(grey, metric, ap_size, min_brightness, keys)
    half = ap_size // 2
    search, at = half + search_radius, np.arange(2 * half) - half
    chosen = quality.select_fraction(ap_scores(grey, offsets, reference, ap_size, metric, keys), select, (*keys, "ap_index"))
    wanted = chosen.groupBy(*keys, "frame_index").agg(F.collect_list(F.struct("ap_index", "cy", "cx", "score")).alias("aps"))
    slim = frames.select(*keys, "frame_index", "height", "width", "r", "g", "b").join(wanted, [*keys, "frame_index"]).join(offsets, [*keys, "frame_index"])

    def patches(r, g, b, known, aps, dy, dx):
        grey, out = K.luminance(r, g, b), []
        for p in aps:
            cy, cx = p["cy"], p["cx"]
            y, x, confidence = K.phase_offset(K.spectrum(K.region(known, cy, cx, search)), K.region_shifted(grey, cy, cx, search, dy, dx))
            if confidence >= K.CONFIDENCE_LEAST:
                places = np.meshgrid(cy + at - dy - y, cx + at - dx - x, indexing="ij")
                out.append({**p, **{c: K.bilinear(a, *places).astype(np.float32).ravel() for c, a in zip("rgb", (r, g, b), strict=True)}})
        return out

    def known_patches(a, aps):
        return [{**p, "score": 0.0, **dict.fromkeys("rgb", K.region(a, p["cy"], p["cx"], half).astype(np.float32).ravel())} for p in aps]

    planes = ", ".join(f"{c}: array<float>" for c in "rgb")
    found = {"found": f"array<struct<{_PLACE}, score: double, {planes}>>"}
    both = align.with_reference(slim, reference, keys)
    cut = map_frames(both, patches, found, pixels=("r", "g", "b", "ref_pixels"), args=("aps", "dy", "dx"), drop=("r", "g", "b", "ref_pixels", "aps", "dy", "dx"))
    own = map_frames(reference.withColumn("frame_index", F.lit(OF_REFERENCE).cast("long")), known_patches, found, args=("aps",), drop=("pixels", "aps"))
    cut = cut.unionByName(own).select(*keys, "frame_index", "height", "width", F.inline("found"))
    schema = T.StructType([*(cut.schema[k] for k in (*keys, "height", "width", "ap_index", "cy", "cx")), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in "rgb")])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def local_stack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            own = [[x.values.to_numpy(zero_copy_only=False) for x in b.column(c)] for c in "rgb"]
            rows += zip(b.column("score").to_pylist(), b.column("frame_index").to_pylist(), *own, strict=True)
            place = [b.column(c)[0].as_py() for c in ("height", "width", "cy", "cx")]
        used = sorted((r for r in rows if r[1] != OF_REFERENCE), key=lambda r: (-r[0], r[1])) or rows  # the reference where no match is good
        side = 2 * half
        out = [K.stacked(np.array([r[2 + c].astype(np.float64).reshape(side, side) for r in used]), local, np.array([r[0] for r in used]), sigma, iterations) for c in range(3)]
        row = [*(k.as_py() for k in key[:-1]), *place[:2], key[-1].as_py(), *place[2:], *(a.ravel() for a in out)]
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    stacks = batched(cut).groupBy(*keys, "ap_index").applyInArrow(local_stack, schema)
    return blend(stacks, ap_size, keys, dict(zip("rgb", "rgb", strict=True)))


def blend(stacks: DataFrame, ap_size: int, keys: tuple[str, ...] = (), columns: dict[str, str] | None = None) -> DataFrame:
    """One frame of each capture from (keys, height, width, ap_index, cy, cx) and
    the patches in columns, which names the result's planes; by default pixels
    from patch. At most four patches lie over a pixel, so the patches of a capture
    are about four frames: one task blends them."""
    columns = columns or {"pixels": "patch"}
    side = ap_size // 2 * 2
    schema = T.StructType([*(stacks.schema[k] for k in (*keys, "height", "width")), *(T.StructField(c, T.ArrayType(T.FloatType())) for c in columns)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def laid(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, patches = [], {c: [] for c in columns}
        for b in batches:
            h, w = b.column("height")[0].as_py(), b.column("width")[0].as_py()
            places += zip(*(b.column(c).to_pylist() for c in ("ap_index", "cy", "cx")), strict=True)
            for c, name in columns.items():
                patches[c] += [x.values.to_numpy(zero_copy_only=False).reshape(side, side) for x in b.column(name)]
        order = sorted(range(len(places)), key=lambda i: places[i][0])
        out = [K.blended([(*places[i][1:], own[i]) for i in order], (h, w), ap_size) for own in patches.values()]
        row = [*(k.as_py() for k in key[: len(keys)]), h, w, *(a.ravel().astype(np.float32) for a in out)]
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return (batched(stacks).groupBy(*keys) if keys else batched(stacks.withColumn("one", F.lit(0))).groupBy("one")).applyInArrow(laid, schema)


def surface_warp_stack(frames: DataFrame, ap_size: int = 64, search_radius: int = 16, select: float = 0.25, min_brightness: float = 0.05, metric: str = "laplacian", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (keys, height, width, pixels) for each capture: the best frames,
    warped by the shifts of the alignment points and what lies between them, as
    a mean by quality."""
    offsets, reference = _prepared(frames, metric, ap_size, min_brightness, keys)
    best = quality.select_fraction(quality.score_frames(frames, metric, keys), select, keys).select(*keys, "frame_index", "score")
    slim = frames.select(*keys, "frame_index", "height", "width", "pixels").join(best, [*keys, "frame_index"]).join(offsets, [*keys, "frame_index"])

    def warp(a, known, aps, dy, dx):
        grid = [(p["ap_index"], p["cy"], p["cx"]) for p in aps]
        shifts = K.local_shifts(a, known, grid, dy, dx, ap_size, search_radius)
        return K.warped(a, *K.shift_field(grid, shifts, dy, dx, a.shape, ap_size))

    both = align.with_reference(slim, reference, keys, ("pixels", "aps"))
    moved = map_frames(both, warp, {"pixels": "array<float>"}, pixels=("pixels", "ref_pixels"), args=("ref_aps", "dy", "dx"), drop=("ref_pixels", "ref_aps", "dy", "dx"))
    return stack.mean_stack(moved, keys, weight="score").select(*keys, "height", "width", F.col("pixels").cast("array<float>").alias("pixels"))


def surface_warp_stack_colour(frames: DataFrame, ap_size: int = 64, search_radius: int = 16, select: float = 0.25, min_brightness: float = 0.05, metric: str = "laplacian", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (keys, height, width, r, g, b) for each capture: the frames that
    are best by luminance, each channel warped by the shifts of the luminance, as
    a mean by quality."""
    grey = filters.luminance(frames)
    offsets, reference = _prepared(grey, metric, ap_size, min_brightness, keys)
    best = quality.select_fraction(quality.score_frames(grey, metric, keys), select, keys).select(*keys, "frame_index", "score")
    slim = frames.select(*keys, "frame_index", "height", "width", "r", "g", "b").join(best, [*keys, "frame_index"]).join(offsets, [*keys, "frame_index"])

    def warp(r, g, b, known, aps, dy, dx):
        grid = [(p["ap_index"], p["cy"], p["cx"]) for p in aps]
        shifts = K.local_shifts(K.luminance(r, g, b), known, grid, dy, dx, ap_size, search_radius)
        field = K.shift_field(grid, shifts, dy, dx, r.shape, ap_size)
        return tuple(K.warped(a, *field) for a in (r, g, b))

    both = align.with_reference(slim, reference, keys, ("pixels", "aps"))
    moved = map_frames(both, warp, dict.fromkeys("rgb", "array<float>"), pixels=("r", "g", "b", "ref_pixels"), args=("ref_aps", "dy", "dx"), drop=("ref_pixels", "ref_aps", "dy", "dx")).persist()
    out = None
    for c in "rgb":
        plane = moved.select(*keys, "frame_index", "height", "width", "score", F.col(c).alias("pixels"))
        mean = stack.mean_stack(plane, keys, weight="score").select(*keys, "height", "width", F.col("pixels").cast("array<float>").alias(c))
        out = mean if out is None else out.join(mean, [*keys, "height", "width"])  # a row for each capture
    return out
