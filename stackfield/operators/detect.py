"""Detection of the bright object of a frame, and automatic crops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptySequence, InvalidCrop, PipelineError
from ..frames import map_frames
from ..functions import kernels as K
from ..schema import DETECTION
from .quality import sample_frames

FALLBACK_FRAMES = 5
LEAST_DETECTIONS = 3


def thresholds(frames: DataFrame, method="otsu", sigmas: float = 2.0) -> DataFrame:
    """(…, threshold) in the place of pixels."""
    return map_frames(frames, lambda a: K.threshold(a, method, sigmas), {"threshold": "double"}, drop=("pixels",))


def opened_masks(frames: DataFrame, threshold: float) -> DataFrame:
    """mask, 0 and 1, in the place of pixels: above threshold, eroded and dilated."""
    return map_frames(frames, lambda a: [int(v) for v in K.opened(a > threshold).ravel()], {"mask": "array<int>"}, drop=("pixels",))


def component_table(frames: DataFrame, threshold: float, opening: bool = False) -> DataFrame:
    """One row per component: label, area, min_row, max_row, min_col, max_col, and its place by size."""
    names = ("label", "area", "min_row", "max_row", "min_col", "max_col")
    kernel = lambda a: [dict(zip(names, c, strict=True)) for c in K.components(K.opened(a > threshold) if opening else a > threshold)]
    kind = "array<struct<label: int, area: long, min_row: int, max_row: int, min_col: int, max_col: int>>"
    out = map_frames(frames, kernel, {"found": kind}, drop=("pixels",))
    return out.select(*(c for c in out.columns if c != "found"), F.posexplode("found").alias("place", "x")).select("*", "x.*").drop("x")


def backgrounds(frames: DataFrame) -> DataFrame:
    return map_frames(frames, K.background, {"background": "double"}, drop=("pixels",))


def detections(frames: DataFrame, method="otsu", sigmas: float = 2.0, blur: float = 2.5, min_area: int = 100) -> DataFrame:
    """(…, detection), null where there is none, in the place of pixels."""
    names = ("cy", "cx", "bbox_width", "bbox_height", "area")

    def kernel(a):
        found = K.detected(a, method, sigmas, blur, min_area)
        return found and dict(zip(names, found, strict=True))

    return map_frames(frames, kernel, {"detection": DETECTION}, drop=("pixels",))


def validated_crop(rect: tuple[int, int, int, int], width: int, height: int, bayer: bool = False) -> tuple[int, int, int, int]:
    """(x, y, width, height), even for a mosaic, and within the frame."""
    if bayer:
        rect = tuple(v // 2 * 2 for v in rect)
    x, y, w, h = rect
    if w <= 0 or h <= 0:
        raise InvalidCrop(f"the crop is {w} by {h}")
    if x < 0 or y < 0 or x + w > width or y + h > height:
        raise InvalidCrop(f"{rect} is not within {width} by {height}")
    return x, y, w, h


def aspect_snapped(width: int, height: int, ratio: str = "free") -> tuple[int, int]:
    """The largest size of a ratio (free, 1:1, 3:4, 4:3, 16:9) within width and height."""
    if ratio == "free":
        return width, height
    a, b = map(int, ratio.split(":"))
    return (width, width * b // a) if width * b <= height * a else (height * a // b, height)


def auto_crop(frames: DataFrame, sample_count: int = 30, padding: float = 0.15, align: int = 32, bayer: bool = False, method="otsu", sigmas: float = 2.0, blur: float = 2.5, min_area: int = 100) -> tuple[int, int, int, int]:
    """(x, y, width, height) around the object of one capture.

    At most sample_count frames are looked at, and their detections, as many
    rows, are collected. With fewer than three of them, the median of the five
    middle frames is looked at, with lower and lower thresholds.
    """
    head = frames.agg(F.count("*").alias("n"), F.max("height").alias("h"), F.max("width").alias("w")).first()
    if not head["n"]:
        raise EmptySequence("there are no frames to crop")
    n, h, w = head["n"], head["h"], head["w"]
    slim = frames.select("frame_index", "height", "width", "pixels")
    found = [r["detection"] for r in detections(sample_frames(slim, n, sample_count), method, sigmas, blur, min_area).filter("detection IS NOT NULL").orderBy("frame_index").collect()]
    rect = lambda seen: validated_crop(K.crop_rect(K.drift(*(np.array([d[k] for d in seen], dtype=float) for k in ("cx", "cy", "bbox_width", "bbox_height"))), w, h, padding, align), w, h, bayer)
    if len(found) >= LEAST_DETECTIONS:
        return rect(found)
    count = min(FALLBACK_FRAMES, n)
    start = max(n // 2 - count // 2, 0)
    middle = slim.filter(F.col("frame_index").isin([min(i, n - 1) for i in range(start, start + count)])).orderBy("frame_index").collect()
    combined = np.median([np.array(r["pixels"], dtype=float).reshape(h, w) for r in middle], 0)
    base = K.otsu(K.gaussian_blur(combined, blur))
    for how in (method, 0.8 * base, 0.6 * base):
        one = K.detected(combined, how, sigmas, blur, min_area)
        if one:
            return rect([dict(zip(("cy", "cx", "bbox_width", "bbox_height", "area"), one, strict=True))])
    raise PipelineError("no object was found, even with lower thresholds")
