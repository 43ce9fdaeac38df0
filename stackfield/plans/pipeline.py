"""A run: score, select, align, stack, sharpen, filter.

Scores are made first, and carry no pixels; the selected frames are then joined
by index and fetched once more. A run's result is one frame.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptySequence
from ..functions import kernels as K
from ..operators import align, detect, filters, multipoint, quality, stack
from ..sources import images, ser
from .config import Config


def is_colour(head: ser.Header, config: Config) -> bool:
    if config.force_mono or head.colour == "mono":
        return False
    return head.planes == 3 or config.debayer != "off"


def _selected(frames: DataFrame, config: Config) -> tuple[DataFrame, int]:
    """The selected frames with score, and the index of the best of them."""
    scores = quality.score_frames(frames, config.metric).persist()
    best = quality.top_n(scores, 1).first()
    if best is None:
        raise EmptySequence("there are no frames")
    return frames.join(quality.select_fraction(scores, config.select).select("frame_index", "score"), "frame_index"), best["frame_index"]


def _aligner(config: Config) -> dict:
    return {"enhanced": {"upsample": config.upsample}, "centroid": {"threshold": config.centroid_threshold}, "pyramid": {"levels": config.pyramid_levels}}.get(config.align, {})


def _points(config: Config) -> dict:
    return {"ap_size": config.ap_size, "search_radius": config.search_radius, "select": config.select, "min_brightness": config.min_brightness, "metric": config.metric}


def sized(frames: DataFrame, config: Config) -> Config:
    """config with a size of alignment points: 0 becomes one that suits the object
    detected in frame 0, or without one the frame's shorter side."""
    if config.ap_size or config.stack not in ("multi_point", "surface_warp"):
        return config
    first = frames.filter(F.col("frame_index") == 0).select("frame_index", "height", "width", "pixels")
    row = detect.detections(first).first()
    if row is None:
        raise EmptySequence("there is no frame 0")
    found = row["detection"]
    across = max(found["bbox_width"], found["bbox_height"]) if found else min(row["height"], row["width"])
    return replace(config, ap_size=K.auto_ap_size(across))


def stacked(frames: DataFrame, config: Config) -> DataFrame:
    """One row (height, width, pixels) from mono frames, indices from 0.

    Multi-point and surface-warp stacks align by phase correlation with frame 0
    and select by themselves; the others align with the best frame.
    """
    common = _points(sized(frames, config))
    if config.stack == "multi_point":
        return multipoint.multi_point_stack(frames, local=config.local_stack, sigma=config.sigma, iterations=config.iterations, **common)
    if config.stack == "surface_warp":
        return multipoint.surface_warp_stack(frames, **common)
    chosen, best = _selected(frames, config)
    reference = chosen.filter(F.col("frame_index") == best).select("pixels")
    if config.stack == "drizzle":
        found = align.offsets(chosen, reference, method=config.align, sign=config.sign, **_aligner(config)).select("frame_index", "dy", "dx")
        own = F.col("frame_index") == best
        laid = chosen.join(found, "frame_index").withColumns({"dy": F.when(own, 0.0).otherwise(F.col("dy")), "dx": F.when(own, 0.0).otherwise(F.col("dx"))})
        out = stack.drizzle_stack(laid, scale=config.scale, pixfrac=config.pixfrac, weight="score" if config.quality_weighted else None, sign=config.sign)
    else:
        moved = align.align(chosen.withColumn("best", F.lit(best)), reference, method=config.align, sign=config.sign, reference_index="best", **_aligner(config))
        out = stack.mean_stack(moved) if config.stack == "mean" else stack.robust_stack(moved, config.stack, (), config.sigma, config.iterations)
    return out.select("height", "width", F.col("pixels").cast("array<float>").alias("pixels"))


def stacked_colour(frames: DataFrame, config: Config) -> DataFrame:
    """One row (height, width, r, g, b): scores and offsets by luminance, then
    every channel moved and stacked alike."""
    grey = filters.luminance(frames)
    config = sized(grey, config)
    if config.stack == "multi_point":
        return multipoint.multi_point_stack_colour(frames, local=config.local_stack, sigma=config.sigma, iterations=config.iterations, **_points(config))
    if config.stack == "surface_warp":
        return multipoint.surface_warp_stack_colour(frames, **_points(config))
    planes = {c: frames.select("frame_index", "height", "width", F.col(c).alias("pixels")) for c in "rgb"}
    chosen, best = _selected(grey, config)
    reference = chosen.filter(F.col("frame_index") == best).select("pixels")
    own = F.col("frame_index") == best
    found = align.offsets(chosen, reference, method=config.align, sign=config.sign, **_aligner(config))
    found = found.select("frame_index", F.when(own, 0.0).otherwise(F.col("dy")).alias("dy"), F.when(own, 0.0).otherwise(F.col("dx")).alias("dx"))
    moves = chosen.select("frame_index", "score").join(found, "frame_index").persist()
    done = {}
    for c, p in planes.items():
        p = p.join(moves, "frame_index")
        if config.stack == "drizzle":
            done[c] = stack.drizzle_stack(p, scale=config.scale, pixfrac=config.pixfrac, weight="score" if config.quality_weighted else None, sign=config.sign)
        else:
            moved = align.shift(p)
            done[c] = stack.mean_stack(moved) if config.stack == "mean" else stack.robust_stack(moved, config.stack, (), config.sigma, config.iterations)
    out = None
    for c, one in done.items():  # three rows of one frame each
        one = one.select("height", "width", F.col("pixels").cast("array<float>").alias(c))
        out = one if out is None else out.join(one, ["height", "width"])
    return out


def finished(frame: DataFrame, config: Config, columns: tuple[str, ...]) -> DataFrame:
    """Deconvolution, then wavelets, then filters in their order."""
    for c in columns:
        if config.deconvolution:
            frame = filters.deconvolve(frame, config.deconvolution, config.psf, config.psf_value, config.rl_iterations, config.wiener_noise, c)
        if config.sharpen:
            frame = filters.wavelet_sharpen(frame, config.layers, tuple(config.coefficients), tuple(config.denoise), c)
        frame = filters.apply_filters(frame, [(f["name"], {k: v for k, v in f.items() if k != "name"}) for f in config.filters], c)
    return frame


def run(spark: SparkSession, config: Config) -> DataFrame:
    """The result of a run over config.input: one row, pixels or r, g, b."""
    head = ser.read_header(config.input)
    if not head.frame_count:
        raise EmptySequence(f"{config.input} has no frames")
    if is_colour(head, config):
        method = "mhc" if config.debayer == "mhc" else "bilinear"
        return finished(stacked_colour(ser.read_ser(spark, config.input, "colour", method=method), config), config, ("r", "g", "b"))
    return finished(stacked(ser.read_ser(spark, config.input), config), config, ("pixels",))


def save(frame: DataFrame, path: str) -> None:
    """The one row of a run as an image."""
    row = frame.first()
    if row is None:
        raise EmptySequence("there is nothing to save")
    planes = ["r", "g", "b"] if "r" in frame.columns else ["pixels"]
    images.save(path, *(np.array(row[c], dtype=np.float32).reshape(row["height"], row["width"]) for c in planes))


