"""Filters, colour, sharpening: one frame in, one frame out.

Pointwise filters are expressions over the array of pixels and stay in the JVM;
filters that look at neighbours or sort are kernels over Arrow batches.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import map_frames
from ..functions import kernels as K

PIXELS = "array<float>"


def _each(frames: DataFrame, column: str, f) -> DataFrame:
    return frames.withColumn(column, F.transform(F.col(column), lambda v: f(v.cast("double")).cast("float")))


def unit(v):
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def histogram_stretch(frames: DataFrame, black: float, white: float, column: str = "pixels") -> DataFrame:
    span = white - black
    return _each(frames, column, lambda v: unit((v - F.lit(float(black))) / F.lit(1.0 if abs(span) < 1e-10 else float(span))))


def gamma(frames: DataFrame, value: float, column: str = "pixels") -> DataFrame:
    return _each(frames, column, lambda v: F.pow(unit(v), F.lit(1.0 / value)))


def brightness_contrast(frames: DataFrame, brightness: float = 0.0, contrast: float = 1.0, column: str = "pixels") -> DataFrame:
    return _each(frames, column, lambda v: unit((v - F.lit(0.5)) * F.lit(float(contrast)) + F.lit(0.5) + F.lit(float(brightness))))


def auto_stretch(frames: DataFrame, low: float = 0.001, high: float = 0.999, column: str = "pixels") -> DataFrame:
    return map_frames(frames, partial(K.auto_stretch, low=low, high=high), {column: PIXELS}, (column,))


def gaussian_blur(frames: DataFrame, sigma: float, column: str = "pixels") -> DataFrame:
    return map_frames(frames, partial(K.gaussian_blur, sigma=sigma), {column: PIXELS}, (column,))


def unsharp_mask(frames: DataFrame, radius: float = 1.5, amount: float = 1.0, threshold: float = 0.0, column: str = "pixels") -> DataFrame:
    return map_frames(frames, partial(K.unsharp_mask, radius=radius, amount=amount, threshold=threshold), {column: PIXELS}, (column,))


def sobel(frames: DataFrame, column: str = "pixels") -> DataFrame:
    return map_frames(frames, K.sobel, {column: PIXELS}, (column,))


STEPS = {"histogram_stretch": histogram_stretch, "auto_stretch": auto_stretch, "gamma": gamma, "brightness_contrast": brightness_contrast, "unsharp_mask": unsharp_mask, "gaussian_blur": gaussian_blur}


def apply_filters(frames: DataFrame, steps: list[tuple[str, dict]], column: str = "pixels") -> DataFrame:
    """steps (name, parameters), in their order."""
    for name, params in steps:
        if name not in STEPS:
            raise ValueError(f"unknown filter {name!r}")
        frames = STEPS[name](frames, column=column, **params)
    return frames


def quantise(frames: DataFrame, most: int, column: str = "pixels") -> DataFrame:
    """Whole numbers from 0 to most (65535 or 255), cut off and not rounded."""
    return frames.withColumn(column, F.transform(F.col(column), lambda v: F.floor(F.least(F.greatest(v.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float")) * F.lit(most).cast("float")).cast("int")))


# --- colour ----------------------------------------------------------------


def luminance(frames: DataFrame) -> DataFrame:
    """pixels from r, g, b."""
    r, g, b = (F.lit(w) for w in K.LUMINANCE)
    mix = F.transform(F.arrays_zip("r", "g", "b"), lambda x: (r * x["r"].cast("double") + g * x["g"].cast("double") + b * x["b"].cast("double")).cast("float"))
    return frames.select(*(c for c in frames.columns if c not in "rgb"), mix.alias("pixels"))


def debayer(frames: DataFrame, pattern: str, method: str = "bilinear") -> DataFrame:
    """r, g, b in the place of a mosaic's pixels. pattern: rggb, grbg, gbrg or bggr; method: bilinear or mhc."""
    if pattern not in K.RED_AT:
        raise ValueError(f"{pattern!r} is no mosaic")
    return map_frames(frames, partial(K.debayer, pattern=pattern, method=method), dict.fromkeys("rgb", PIXELS), drop=("pixels",))


def per_channel(frames: DataFrame, f) -> DataFrame:
    """f(frames, column=...) for each of r, g and b."""
    for c in "rgb":
        frames = f(frames, column=c)
    return frames


def rgb_align(frames: DataFrame, red: tuple[float, float] | None = None, blue: tuple[float, float] | None = None) -> DataFrame:
    """Red and blue moved onto green, by phase correlation or by given (dy, dx)."""

    def moved(r, g, b):
        ref = K.Aligner(g)
        red_by, blue_by = red or ref.offset(r)[:2], blue or ref.offset(b)[:2]
        return K.warped(r, *red_by), K.warped(b, *blue_by), *(float(v) for v in (*red_by, *blue_by))

    return map_frames(frames, moved, {"r": PIXELS, "b": PIXELS, "red_dy": "double", "red_dx": "double", "blue_dy": "double", "blue_dx": "double"}, ("r", "g", "b"))


# --- sharpening ------------------------------------------------------------


def wavelet_sharpen(frames: DataFrame, layers: int = 6, coefficients: tuple[float, ...] = K.WAVELET_COEFFICIENTS, denoise: tuple[float, ...] = (), column: str = "pixels") -> DataFrame:
    return map_frames(frames, partial(K.wavelet_sharpened, layers=layers, coefficients=coefficients, denoise=denoise), {column: PIXELS}, (column,))


def wavelet_decompose(frames: DataFrame, layers: int = 6) -> DataFrame:
    """details, an array of layers of pixels, and residual, besides pixels."""

    def cut(a):
        details, rest = K.wavelet_layers(a, layers)
        return [d.ravel().astype("float32") for d in details], rest

    return map_frames(frames, cut, {"details": "array<array<float>>", "residual": PIXELS})


def deconvolve(frames: DataFrame, method: str = "richardson_lucy", psf: str = "gaussian", psf_value: float = 2.0, iterations: int = 20, noise: float = 0.001, column: str = "pixels") -> DataFrame:
    """The point spread function is made once for each size of frame in a task."""
    if method not in ("richardson_lucy", "wiener"):
        raise ValueError(f"unknown method {method!r}")
    made: dict = {}

    def kernel(a):
        p = made.get(a.shape)
        if p is None:
            p = made[a.shape] = K.psf(psf, psf_value, a.shape)
        return K.richardson_lucy(a, p, iterations) if method == "richardson_lucy" else K.wiener(a, p, noise)

    return map_frames(frames, kernel, {column: PIXELS}, (column,))


def crop(frames: DataFrame, x: int, y: int, width: int, height: int, columns: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """A rectangle of each frame; expressions over the arrays of pixels."""
    cut = lambda c: F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + height - 1)), lambda r: F.slice(F.col(c), r * F.col("width") + x + 1, width)))
    return frames.withColumns({c: cut(c) for c in columns}).withColumns({"height": F.lit(height), "width": F.lit(width)})
