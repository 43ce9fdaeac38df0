"""Registration: offsets of frames against the reference frame of their capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import map_frames
from ..functions import kernels as K

#: Values of all reference frames together up to which they are broadcast: 64 MB.
REFERENCE_BROADCAST = 16_000_000


def with_reference(frames: DataFrame, reference: DataFrame, keys: tuple[str, ...] = (), columns: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """frames with ref_pixels, the pixels of the one reference (keys, pixels) of
    their capture. References are broadcast if all of them are small; else
    frames and references meet by a shuffle on the keys."""
    ref = reference.select(*keys, *(F.col(c).alias(f"ref_{c}") for c in columns))
    size = ref.select(F.sum(F.size(f"ref_{columns[0]}"))).first()[0] or 0
    if not keys:  # one row
        return frames.crossJoin(F.broadcast(ref))
    return frames.join(F.broadcast(ref) if size * len(columns) <= REFERENCE_BROADCAST else ref, list(keys))


def offsets(frames: DataFrame, reference: DataFrame, keys: tuple[str, ...] = (), method: str = "phase", sign: str = "compat", **params) -> DataFrame:
    """(keys, frame_index, dy, dx, confidence). method: phase, enhanced, centroid,
    gradient or pyramid, with the parameters of Aligner; confidence is null where
    the method has none. What is made of a reference is made once for a run of
    frames of its capture."""
    both = with_reference(frames.select(*keys, "frame_index", "height", "width", "pixels"), reference, keys)
    last: list = [None, None]

    def kernel(a, ref):
        if last[0] is None or len(ref) != last[0].size or not (last[0] == ref).all():
            import numpy as np

            last[0] = np.asarray(ref, dtype=np.float64)
            last[1] = K.Aligner(last[0].reshape(a.shape), method, sign, **params)
        dy, dx, confidence = last[1].offset(a)
        return float(dy), float(dx), confidence

    return map_frames(both, kernel, {"dy": "double", "dx": "double", "confidence": "double"}, args=("ref_pixels",), drop=("height", "width", "pixels", "ref_pixels"))


def shift(frames: DataFrame, columns: tuple[str, ...] = ("pixels",), dy: str = "dy", dx: str = "dx") -> DataFrame:
    """Each frame moved by its own (dy, dx): out(r, c) = in(r - dy, c - dx), bilinear, 0 outside."""
    for c in columns:
        frames = map_frames(frames, K.warped, {c: "array<float>"}, (c,), (dy, dx))
    return frames


def align(frames: DataFrame, reference: DataFrame, keys: tuple[str, ...] = (), method: str = "phase", sign: str = "compat", reference_index: str | None = None, **params) -> DataFrame:
    """frames moved onto their reference in one pass, with dy, dx, confidence. A
    frame whose index is in the column reference_index passes through."""
    both = with_reference(frames, reference, keys)
    last: list = [None, None]

    def kernel(a, ref, index, own):
        import numpy as np

        if index == own:
            return a, 0.0, 0.0, None
        if last[0] is None or len(ref) != last[0].size or not (last[0] == ref).all():
            last[0] = np.asarray(ref, dtype=np.float64)
            last[1] = K.Aligner(last[0].reshape(a.shape), method, sign, **params)
        dy, dx, confidence = last[1].offset(a)
        return K.warped(a, dy, dx), float(dy), float(dx), confidence

    both = both.withColumn("__own", F.col(reference_index) if reference_index else F.lit(None).cast("long"))
    return map_frames(both, kernel, {"pixels": "array<float>", "dy": "double", "dx": "double", "confidence": "double"}, args=("ref_pixels", "frame_index", "__own"), drop=("ref_pixels", "__own"))


def pyramid_level(frames: DataFrame, level: int = 1) -> DataFrame:
    """The frame after so many steps of blur and halving."""

    def kernel(a):
        out = K.pyramid(a, level)[level]
        return out, out.shape[0], out.shape[1]

    return map_frames(frames, kernel, {"pixels": "array<float>", "height": "int", "width": "int"})


def cross_spectrum(frames: DataFrame) -> DataFrame:
    """re and im of the unnormalised two-dimensional Fourier transform, besides pixels."""

    def kernel(a):
        import numpy as np

        f = np.fft.fft2(a)
        return list(f.real.ravel()), list(f.imag.ravel())

    return map_frames(frames, kernel, {"re": "array<double>", "im": "array<double>"})
