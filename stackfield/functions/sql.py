"""Kernels as SQL functions: pandas functions over (pixels, height, width) and, where
a kernel has them, numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import kernels as K


def _rows(pixels: pd.Series, height: pd.Series, width: pd.Series, *numbers: pd.Series):
    """The image of each row and its numbers."""
    for p, h, w, *more in zip(pixels, height, width, *numbers, strict=True):
        yield np.asarray(p, dtype=np.float64).reshape(h, w), *(float(x) for x in more)


def _scalar(kernel):
    def f(*columns: pd.Series) -> pd.Series:
        return pd.Series([kernel(*row) for row in _rows(*columns)], dtype="float64")

    return F.pandas_udf(f, "double")


def _image(kernel):
    def f(*columns: pd.Series) -> pd.Series:
        return pd.Series([kernel(*row).astype(np.float32).ravel() for row in _rows(*columns)], dtype="object")

    return F.pandas_udf(f, "array<float>")


def _centroid(*columns: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([K.centroid(*row) for row in _rows(*columns)], columns=["cy", "cx"])


def _phase(reference: pd.Series, target: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    rows = [K.phase_offset(K.spectrum(np.asarray(r, dtype=np.float64).reshape(h, w)), np.asarray(t, dtype=np.float64).reshape(h, w)) for r, t, h, w in zip(reference, target, height, width, strict=True)]
    return pd.DataFrame(rows, columns=["dy", "dx", "confidence"])


def register(spark: SparkSession) -> None:
    """Of (pixels, height, width): laplacian_variance, gradient_score, otsu_level,
    auto_stretch, wavelet_sharpen, sobel_image, and with numbers after these three
    histogram_stretch (black, white), gamma_image (gamma), brightness_contrast
    (brightness, contrast), gaussian_blur (sigma), unsharp_mask (radius, amount,
    threshold) and image_centroid (threshold, if not 0.1; a struct of cy and cx);
    and phase_offset (reference, target, height, width)."""
    ship(spark)
    for name, kernel in (("laplacian_variance", K.laplacian_variance), ("gradient_score", K.gradient_score), ("otsu_level", K.otsu)):
        spark.udf.register(name, _scalar(kernel))
    for name, kernel in (("auto_stretch", K.auto_stretch), ("wavelet_sharpen", K.wavelet_sharpened), ("sobel_image", K.sobel), ("histogram_stretch", K.stretch), ("gamma_image", K.gamma), ("brightness_contrast", K.brightness_contrast), ("gaussian_blur", K.gaussian_blur), ("unsharp_mask", K.unsharp_mask)):
        spark.udf.register(name, _image(kernel))
    spark.udf.register("image_centroid", F.pandas_udf(_centroid, "cy double, cx double"))
    spark.udf.register("phase_offset", F.pandas_udf(_phase, "dy double, dx double, confidence double"))
