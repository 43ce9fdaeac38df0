"""Queries over the embeddings, read as captures: each vector of 64 values is a
frame of 8 by 8, and its label the capture that it belongs to.

Values are rounded once, to DIGITS decimals, where they leave a query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import map_frames
from .functions import kernels as K
from .operators import align, detect, filters, multipoint, quality, stack
from .schema import interleaved_to_planes, planes_to_interleaved, to_pixels

SIDE = 8
DIGITS = 6
KEY = ("label",)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_index, label, height, width, pixels."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return raw.select(F.col("vec_id").alias("frame_index"), "label", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.col("embedding").alias("pixels"))


def unit_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values moved by half and held within 0 and 1."""
    return captures(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: F.least(F.greatest(v.cast("double") + F.lit(0.5), F.lit(0.0)), F.lit(1.0)).cast("float")))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in columns})


def pixel_rows(frames: DataFrame, *keys: str) -> DataFrame:
    return rounded(to_pixels(frames, *keys), "v")


def scores(spark: SparkSession, sf_dir: str, metric: str = "laplacian") -> DataFrame:
    """Rounded before they are ranked, so that both engines break ties alike."""
    return quality.score_frames(captures(spark, sf_dir), metric, KEY).withColumn("score", F.round("score", 9))


def first_frames(frames: DataFrame) -> DataFrame:
    """The frame of the lowest index of each capture."""
    return frames.groupBy("label").agg(F.min_by("pixels", "frame_index").alias("pixels"), F.min("frame_index").alias("first_index"))


# --- quality and selection ---------------------------------------------------


def laplacian_score(spark, sf_dir):
    return scores(spark, sf_dir).select("frame_index", F.round("score", DIGITS).alias("score"))


def gradient_score(spark, sf_dir):
    return scores(spark, sf_dir, "gradient").select("frame_index", F.round("score", DIGITS).alias("score"))


def rank_frames(spark, sf_dir):
    return quality.rank_frames(scores(spark, sf_dir), KEY).select("label", "frame_index", F.col("rank").cast("long").alias("rank"))


def rank_gradient(spark, sf_dir):
    return quality.rank_frames(scores(spark, sf_dir, "gradient"), KEY).select("label", "frame_index", F.col("rank").cast("long").alias("rank"))


def select_best_frames(spark, sf_dir):
    return quality.select_fraction(scores(spark, sf_dir), 0.25, KEY).select("label", "frame_index", F.col("rank").cast("long").alias("rank"))


def top_n_quality(spark, sf_dir):
    return quality.top_n(scores(spark, sf_dir), 20).select("frame_index", "label", F.round("score", DIGITS).alias("score"))


def quality_summary(spark, sf_dir):
    return rounded(quality.summary(scores(spark, sf_dir), KEY), "best_score", "worst_score")


def sample_frames(spark, sf_dir):
    frames = captures(spark, sf_dir)
    return quality.sample_frames(frames.select("frame_index", "label"), frames.count(), 30)


# --- stacks ------------------------------------------------------------------


def mean_stack(spark, sf_dir):
    return pixel_rows(stack.mean_stack(captures(spark, sf_dir), KEY), "label")


def median_stack(spark, sf_dir):
    return pixel_rows(stack.robust_stack(captures(spark, sf_dir), "median", KEY), "label")


def sigma_clip_stack(spark, sf_dir):
    return pixel_rows(stack.robust_stack(captures(spark, sf_dir), "sigma_clip", KEY), "label")


def weighted_mean_stack(spark, sf_dir):
    frames = captures(spark, sf_dir)
    return pixel_rows(stack.mean_stack(frames.join(scores(spark, sf_dir).drop("label"), "frame_index"), KEY, weight="score"), "label")


def mean_of_selected(spark, sf_dir):
    """The flagship: score, select the best quarter of each capture, stack."""
    best = quality.select_fraction(scores(spark, sf_dir), 0.25, KEY).select("frame_index")
    return pixel_rows(stack.mean_stack(captures(spark, sf_dir).join(best, "frame_index", "left_semi"), KEY), "label")


def drizzle(spark, sf_dir):
    """Offsets are made from the index: a third of a pixel and a quarter, times its remainder by 3 and by 5."""
    frames = unit_captures(spark, sf_dir).withColumns({"dy": (F.col("frame_index") % 3 - 1) / F.lit(3.0), "dx": (F.col("frame_index") % 5 - 2) / F.lit(4.0)})
    return pixel_rows(stack.drizzle_stack(frames, KEY), "label")


# --- filters -----------------------------------------------------------------


def hist_stretch(spark, sf_dir):
    return pixel_rows(filters.histogram_stretch(unit_captures(spark, sf_dir), 0.2, 0.8), "frame_index")


def auto_stretch(spark, sf_dir):
    return pixel_rows(filters.auto_stretch(unit_captures(spark, sf_dir), 0.05, 0.95), "frame_index")


def gamma(spark, sf_dir):
    return pixel_rows(filters.gamma(unit_captures(spark, sf_dir), 2.2), "frame_index")


def brightness_contrast(spark, sf_dir):
    return pixel_rows(filters.brightness_contrast(unit_captures(spark, sf_dir), 0.05, 1.4), "frame_index")


def gaussian_blur(spark, sf_dir):
    return pixel_rows(filters.gaussian_blur(unit_captures(spark, sf_dir), 1.0), "frame_index")


def unsharp_mask(spark, sf_dir):
    return pixel_rows(filters.unsharp_mask(unit_captures(spark, sf_dir), 1.0, 0.8, 0.02), "frame_index")


def sobel(spark, sf_dir):
    return pixel_rows(filters.sobel(captures(spark, sf_dir)), "frame_index")


def filter_chain(spark, sf_dir):
    steps = [("histogram_stretch", {"black": 0.2, "white": 0.8}), ("gamma", {"value": 2.0}), ("brightness_contrast", {"brightness": 0.05, "contrast": 1.2})]
    return pixel_rows(filters.apply_filters(unit_captures(spark, sf_dir), steps), "frame_index")


def quantize16(spark, sf_dir):
    return to_pixels(filters.quantise(unit_captures(spark, sf_dir), 65535), "frame_index")


def quantize8(spark, sf_dir):
    return to_pixels(filters.quantise(unit_captures(spark, sf_dir), 255), "frame_index")


def crop_frames(spark, sf_dir):
    return pixel_rows(filters.crop(captures(spark, sf_dir), 2, 1, 5, 6), "frame_index")


# --- colour ------------------------------------------------------------------


def _planes(frames: DataFrame) -> DataFrame:
    """colour, r, c, v of frames with r, g, b."""
    parts = [pixel_rows(frames.select("frame_index", "height", "width", F.col(c).alias("pixels")), "frame_index").withColumn("colour", F.lit(c)) for c in "rgb"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def debayer_bilinear(spark, sf_dir):
    return _planes(filters.debayer(unit_captures(spark, sf_dir), "rggb"))


def debayer_mhc(spark, sf_dir):
    return _planes(filters.debayer(unit_captures(spark, sf_dir), "grbg", "mhc"))


def luminance(spark, sf_dir):
    return pixel_rows(filters.luminance(filters.debayer(unit_captures(spark, sf_dir), "rggb")), "frame_index")


def _wide(spark, sf_dir) -> DataFrame:
    """Whole frames, each row of 8 values and a 0 being 3 pixels of 3 values."""
    rows = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda r: F.concat(F.slice("pixels", r * SIDE + 1, SIDE), F.array(F.lit(0.0).cast("float"))))
    return captures(spark, sf_dir).select("frame_index", "height", F.lit(SIDE + 1).alias("width"), F.flatten(rows).alias("pixels"))


def split_rgb(spark, sf_dir):
    return _planes(interleaved_to_planes(_wide(spark, sf_dir)))


def merge_rgb(spark, sf_dir):
    planes = interleaved_to_planes(_wide(spark, sf_dir))
    turned = planes.select("frame_index", "height", "width", F.col("b").alias("r"), "g", F.col("r").alias("b"))
    return pixel_rows(planes_to_interleaved(turned), "frame_index")


# --- registration ------------------------------------------------------------


def _offsets(spark, sf_dir, method: str, **params) -> DataFrame:
    frames = unit_captures(spark, sf_dir)
    return align.offsets(frames, first_frames(frames).select("label", "pixels"), KEY, method, **params)


def phase_correlation(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir, "phase"), "dy", "dx", "confidence").select("frame_index", "dy", "dx", "confidence")


def gradient_correlation(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir, "gradient"), "dy", "dx").select("frame_index", "dy", "dx")


def centroid_offset(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir, "centroid", threshold=0.5), "dy", "dx").select("frame_index", "dy", "dx")


def enhanced_phase(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir, "enhanced"), "dy", "dx").select("frame_index", "dy", "dx")


def pyramid_align(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir, "pyramid", levels=2), "dy", "dx").select("frame_index", "dy", "dx")


def shift_frames(spark, sf_dir):
    frames = captures(spark, sf_dir).withColumns({"dy": (F.col("frame_index") % 3 - 1) / F.lit(4.0), "dx": (F.col("frame_index") % 5 - 2) / F.lit(2.0)})
    return pixel_rows(align.shift(frames), "frame_index")


def pyramid_level(spark, sf_dir):
    return pixel_rows(align.pyramid_level(unit_captures(spark, sf_dir), 1), "frame_index")


def fft2d(spark, sf_dir):
    out = align.cross_spectrum(captures(spark, sf_dir))
    rows = out.select("frame_index", F.posexplode(F.arrays_zip("re", "im")).alias("pos", "z"))
    return rounded(rows.select("frame_index", F.floor(F.col("pos") / SIDE).cast("int").alias("u"), (F.col("pos") % SIDE).cast("int").alias("w"), F.col("z.re").alias("re"), F.col("z.im").alias("im")), "re", "im")


def hann_window(spark, sf_dir):
    return pixel_rows(map_frames(captures(spark, sf_dir), lambda a: a * np.outer(K.hann(a.shape[0]), K.hann(a.shape[1])), {"pixels": "array<float>"}), "frame_index")


def rgb_align(spark, sf_dir):
    out = filters.rgb_align(filters.debayer(unit_captures(spark, sf_dir), "rggb"))
    return rounded(out.select("frame_index", "red_dy", "red_dx", "blue_dy", "blue_dx"), "red_dy", "red_dx", "blue_dy", "blue_dx")


# --- sharpening --------------------------------------------------------------


def wavelet_decompose(spark, sf_dir):
    out = filters.wavelet_decompose(unit_captures(spark, sf_dir), 2)
    layers = out.select("frame_index", "height", "width", F.posexplode(F.concat("details", F.array("residual"))).alias("layer", "pixels"))
    return pixel_rows(layers, "frame_index", "layer")


def wavelet_sharpen(spark, sf_dir):
    return pixel_rows(filters.wavelet_sharpen(unit_captures(spark, sf_dir), 2, (1.5, 1.3), (0.02, 0.0)), "frame_index")


def wiener(spark, sf_dir):
    return pixel_rows(filters.deconvolve(unit_captures(spark, sf_dir), "wiener", "gaussian", 1.0, noise=0.01), "frame_index")


def richardson_lucy(spark, sf_dir):
    return pixel_rows(filters.deconvolve(unit_captures(spark, sf_dir), "richardson_lucy", "airy", 2.5, iterations=10), "frame_index")


# --- detection ---------------------------------------------------------------


def threshold_mean_sigma(spark, sf_dir):
    return rounded(detect.thresholds(captures(spark, sf_dir), "mean_sigma", 2.0).select("frame_index", "threshold"), "threshold")


def otsu_threshold(spark, sf_dir):
    return rounded(detect.thresholds(unit_captures(spark, sf_dir), "otsu").select("frame_index", "threshold"), "threshold")


def morph_opening(spark, sf_dir):
    out = detect.opened_masks(captures(spark, sf_dir), -0.1)
    return to_pixels(out, "frame_index", column="mask").select("frame_index", "r", "c", F.col("v").cast("int").alias("v"))


def connected_components(spark, sf_dir):
    out = detect.component_table(captures(spark, sf_dir), 0.05)
    return out.select("frame_index", (F.col("place") + 1).cast("long").alias("place"), "area", "min_row", "max_row", "min_col", "max_col")


def frame_background(spark, sf_dir):
    return rounded(detect.backgrounds(captures(spark, sf_dir)).select("frame_index", "background"), "background")


def masked_centroid(spark, sf_dir):
    def kernel(a):
        rows, cols = np.nonzero(a > 0)
        if not len(rows):
            return None, None
        return tuple(float(v) for v in K.masked_centroid(a, a > 0, (rows.min(), rows.max(), cols.min(), cols.max()), K.background(a)))

    return rounded(map_frames(captures(spark, sf_dir), kernel, {"cy": "double", "cx": "double"}, drop=("pixels",)).select("frame_index", "cy", "cx"), "cy", "cx")


def temporal_analysis(spark, sf_dir):
    """Of each capture: the path of the centroids of its frames."""
    found = map_frames(unit_captures(spark, sf_dir), lambda a: tuple(float(v) for v in K.centroid(a, 0.6)), {"cy": "double", "cx": "double"}, drop=("pixels", "height", "width"))
    rows = found.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("frame_index", "cx", "cy"))).alias("d"))  # numbers, one row per frame of a capture

    def kernel(d):
        cx, cy = (np.array([x[k] for x in d]) for k in ("cx", "cy"))
        out = K.drift(cx, cy, np.ones(len(d)), np.ones(len(d)))
        return out["median_cx"], out["median_cy"], out["drift_range_x"], out["drift_range_y"], out["valid_count"]

    out = map_frames(rows, kernel, {"median_cx": "double", "median_cy": "double", "drift_range_x": "double", "drift_range_y": "double", "valid_count": "long"}, pixels=(), args=("d",), drop=("d",))
    return rounded(out, "median_cx", "median_cy", "drift_range_x", "drift_range_y")


def planet_detect(spark, sf_dir):
    out = detect.detections(unit_captures(spark, sf_dir), blur=0.5, min_area=3).filter("detection IS NOT NULL")
    return rounded(out.select("frame_index", "detection.*"), "cx", "cy")


# --- alignment points --------------------------------------------------------


def ap_grid(spark, sf_dir):
    """Points of side 4 on each frame that are bright enough."""
    out = map_frames(unit_captures(spark, sf_dir), lambda a: [{"ap_index": i, "cy": y, "cx": x} for i, y, x in K.ap_grid(a, 4, 0.5)], {"aps": "array<struct<ap_index: int, cy: int, cx: int>>"}, drop=("pixels",))
    return out.select("frame_index", F.inline("aps"))


def ap_blend(spark, sf_dir):
    """Squares of side 4 cut from each frame and laid over one another again."""
    cut = lambda a: K.blended([(y, x, K.region(a, y, x, 2)) for _, y, x in K.ap_grid(a, 4, 0.5)], a.shape, 4)
    return pixel_rows(map_frames(unit_captures(spark, sf_dir), cut, {"pixels": "array<float>"}), "frame_index")


def _enlarged(spark, sf_dir) -> DataFrame:
    """The frames of all captures, at four times their size, indices from 0 in each capture."""
    frames = unit_captures(spark, sf_dir)
    big = map_frames(frames, lambda a: (K.resized(a, 4 * SIDE, 4 * SIDE), 4 * SIDE, 4 * SIDE), {"pixels": "array<float>", "height": "int", "width": "int"})
    order = frames.select("label", "frame_index").withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("frame_index")))
    return big.join(order, ["label", "frame_index"]).withColumn("frame_index", (F.col("place") - 1).cast("long")).drop("place")


def multi_point_stack(spark, sf_dir):
    return pixel_rows(multipoint.multi_point_stack(_enlarged(spark, sf_dir).persist(), ap_size=16, search_radius=4, keys=KEY), "label")


def surface_warp_stack(spark, sf_dir):
    return pixel_rows(multipoint.surface_warp_stack(_enlarged(spark, sf_dir).persist(), ap_size=16, search_radius=4, keys=KEY), "label")


QUERIES = {f.__name__: f for f in (
    laplacian_score, gradient_score, rank_frames, rank_gradient, select_best_frames, top_n_quality, quality_summary, sample_frames,
    mean_stack, median_stack, sigma_clip_stack, weighted_mean_stack, mean_of_selected, drizzle,
    hist_stretch, auto_stretch, gamma, brightness_contrast, gaussian_blur, unsharp_mask, sobel, filter_chain, quantize16, quantize8, crop_frames,
    debayer_bilinear, debayer_mhc, luminance, split_rgb, merge_rgb,
    phase_correlation, gradient_correlation, centroid_offset, enhanced_phase, pyramid_align, shift_frames, pyramid_level, fft2d, hann_window, rgb_align,
    wavelet_decompose, wavelet_sharpen, wiener, richardson_lucy,
    threshold_mean_sigma, otsu_threshold, morph_opening, connected_components, frame_background, masked_centroid, temporal_analysis, planet_detect,
    ap_grid, ap_blend, multi_point_stack, surface_warp_stack,
)}
