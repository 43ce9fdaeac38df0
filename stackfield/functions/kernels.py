"""Numpy kernels of whole-image operators: arrays in, arrays out, no Spark.

Images are two-dimensional arrays, row-major, values nominally in [0, 1];
offsets are (dy, dx). Everything is computed in float64.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed values that decide results.
B3 = np.array([1, 4, 6, 4, 1]) / 16.0
LUMINANCE = (0.299, 0.587, 0.114)
CONFIDENCE_LEAST = 2.0
SEARCH_WINDOW = 1.5
BORDER_STRIP = 10
OTSU_BINS = 256
F32_EPSILON = float(np.finfo(np.float32).eps)


# --- sharpness -------------------------------------------------------------


def laplacian_variance(a: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian inside the border; 0 below 3 by 3."""
    if min(a.shape) < 3:
        return 0.0
    a = a.astype(np.float64)
    lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
    return float((lap * lap).mean() - lap.mean() ** 2)


def sobel(a: np.ndarray) -> np.ndarray:
    """Gradient magnitude; the border is 0, as is an image below 3 by 3."""
    out = np.zeros(a.shape)
    if min(a.shape) >= 3:
        a = a.astype(np.float64)
        col = lambda c: a[:-2, c] + 2 * a[1:-1, c] + a[2:, c]
        row = lambda r: a[r, :-2] + 2 * a[r, 1:-1] + a[r, 2:]
        gx = col(slice(2, None)) - col(slice(None, -2))
        gy = row(slice(2, None)) - row(slice(None, -2))
        out[1:-1, 1:-1] = np.hypot(gx, gy)
    return out


def gradient_score(a: np.ndarray) -> float:
    return float(sobel(a)[1:-1, 1:-1].mean()) if min(a.shape) >= 3 else 0.0


def quality(a: np.ndarray, metric: str = "laplacian") -> float:
    return gradient_score(a) if metric == "gradient" else laplacian_variance(a)


# --- stencils and pointwise filters ----------------------------------------


def convolved(a: np.ndarray, kernel: np.ndarray, index) -> np.ndarray:
    """Rows, then columns, with the taps at index(positions, length)."""
    half = len(kernel) // 2
    for axis in (1, 0):
        n = a.shape[axis]
        at = np.arange(n)
        a = sum(k * np.take(a, index(at + j - half, n), axis) for j, k in enumerate(kernel))
    return a


def clamped(i: np.ndarray, n: int) -> np.ndarray:
    return np.clip(i, 0, n - 1)


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Period 2n, even: -1 becomes 1, and n becomes n - 1."""
    m = np.abs(i) % (2 * n)
    return np.clip(np.where(m >= n, 2 * n - 1 - m, m), 0, n - 1)


def gaussian_blur(a: np.ndarray, sigma: float) -> np.ndarray:
    half = math.ceil(3 * sigma)
    k = np.exp(-(np.arange(-half, half + 1) ** 2) / (2.0 * sigma * sigma)) if sigma > 0 else np.ones(1)
    return convolved(a.astype(np.float64), k / k.sum(), clamped)


def stretch(a: np.ndarray, black: float, white: float) -> np.ndarray:
    span = white - black
    return np.clip((a - black) / (1.0 if abs(span) < 1e-10 else span), 0, 1)


def auto_stretch(a: np.ndarray, low: float = 0.001, high: float = 0.999) -> np.ndarray:
    v = np.sort(a, axis=None)
    at = lambda p: v[min(int(np.float32(v.size) * np.float32(p)), v.size - 1)]
    return stretch(a, at(low), at(high))


def gamma(a: np.ndarray, g: float) -> np.ndarray:
    return np.clip(a, 0, 1) ** (1.0 / g)


def brightness_contrast(a: np.ndarray, brightness: float, contrast: float) -> np.ndarray:
    return np.clip((a - 0.5) * contrast + 0.5 + brightness, 0, 1)


def unsharp_mask(a: np.ndarray, radius: float, amount: float, threshold: float) -> np.ndarray:
    d = a - gaussian_blur(a, radius)
    return np.where(np.abs(d) > threshold, np.clip(a + d * amount, 0, 1), a)


def quantised(a: np.ndarray, most: int) -> np.ndarray:
    """0 to most, cut off and not rounded."""
    return np.floor(np.clip(a, 0, 1).astype(np.float32) * np.float32(most)).astype(np.uint16 if most > 255 else np.uint8)


# --- sampling and warping --------------------------------------------------


def luminance(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In single precision, as frames hold it."""
    return (LUMINANCE[0] * r + LUMINANCE[1] * g + LUMINANCE[2] * b).astype(np.float32).astype(np.float64)


def bilinear(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Samples at (y, x); neighbours outside the image are 0."""
    h, w = a.shape
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    fy, fx = y - y0, x - x0
    wide = np.zeros((h + 2, w + 2))
    wide[1:-1, 1:-1] = a
    tap = lambda r, c: wide[np.clip(r, -1, h) + 1, np.clip(c, -1, w) + 1]
    return tap(y0, x0) * (1 - fy) * (1 - fx) + tap(y0, x0 + 1) * (1 - fy) * fx + tap(y0 + 1, x0) * fy * (1 - fx) + tap(y0 + 1, x0 + 1) * fy * fx


def warped(a: np.ndarray, dy, dx) -> np.ndarray:
    """out(r, c) = a(r - dy, c - dx), for a shift or a field of shifts."""
    r, c = np.mgrid[: a.shape[0], : a.shape[1]]
    return bilinear(a, r - dy, c - dx)


def region(a: np.ndarray, cy: int, cx: int, half: int) -> np.ndarray:
    """The square of side 2 half around (cy, cx); places outside repeat the edge."""
    at = np.arange(2 * half) - half
    return a[np.ix_(clamped(cy + at, a.shape[0]), clamped(cx + at, a.shape[1]))]


def region_shifted(a: np.ndarray, cy: int, cx: int, half: int, dy: float, dx: float) -> np.ndarray:
    at = np.arange(2 * half) - half
    y, x = np.meshgrid(cy + at - dy, cx + at - dx, indexing="ij")
    return bilinear(a, y, x)


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, with pixel centres at halves and repeated edges."""
    y = np.clip((np.arange(h) + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1)
    return bilinear(a, *np.meshgrid(y, x, indexing="ij"))


# --- registration ----------------------------------------------------------


def hann(n: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))


def spectrum(a: np.ndarray) -> np.ndarray:
    """Of the Hann-windowed image."""
    return np.fft.fft2(a * hann(a.shape[0])[:, None] * hann(a.shape[1])[None, :])


def cross_power(reference: np.ndarray, target: np.ndarray) -> np.ndarray:
    p = reference * target.conj()
    size = np.abs(p)
    return np.where(size > 1e-12, p / np.where(size > 1e-12, size, 1), 0)


def signed(i: int, n: int) -> int:
    return i - n if i > n // 2 else i


def vertex(left: float, mid: float, right: float) -> float:
    """The top of the parabola through three values, within half a step."""
    den = left + right - 2 * mid
    return 0.0 if abs(den) <= 1e-12 else float(np.clip((left - right) / (2 * den), -0.5, 0.5))


def peak_offset(corr: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, confidence) of the first highest value in row-major order."""
    h, w = corr.shape
    r, c = divmod(int(np.argmax(corr)), w)
    sub_y = sub_x = 0.0
    if 0 < r < h - 1 and 0 < c < w - 1:  # a peak at the edge is not refined
        sub_y = vertex(corr[r - 1, c], corr[r, c], corr[r + 1, c])
        sub_x = vertex(corr[r, c - 1], corr[r, c], corr[r, c + 1])
    mean = np.abs(corr).mean()
    return signed(r, h) + sub_y, signed(c, w) + sub_x, float(corr[r, c] / mean) if mean > 1e-15 else 0.0


def phase_offset(reference: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, confidence): the shift that brings target onto reference. reference is its spectrum."""
    return peak_offset(np.fft.ifft2(cross_power(reference, spectrum(target))).real)


def enhanced_offset(reference: np.ndarray, target: np.ndarray, upsample: int = 20, corrected: bool = False) -> tuple[float, float]:
    """(dy, dx) refined by a matrix DFT around the whole-pixel peak; reference is its spectrum.

    As the system that this one matches has it, the search along x is mirrored
    and read back half a step off; corrected=True gives the plain method.
    """
    p = cross_power(reference, spectrum(target))
    h, w = p.shape
    r, c = divmod(int(np.argmax(np.fft.ifft2(p).real)), w)
    dy, dx = float(signed(r, h)), float(signed(c, w))
    if upsample <= 1:
        return dy, dx
    m = math.ceil(SEARCH_WINDOW * upsample)
    steps = (np.arange(m) - (m - 1) / 2) / upsample

    def waves(n: int, centre: float) -> np.ndarray:
        k = np.arange(n)
        k = np.where(k <= n / 2, k, k - n)
        return np.exp(2j * np.pi * np.outer(k, centre + steps) / n)

    across = waves(w, dx)
    found = np.abs(waves(h, dy).T @ p @ (across if corrected else across.conj()))
    i, j = divmod(int(np.argmax(found)), m)
    if corrected:
        return dy + steps[i], dx + steps[j]
    return dy - SEARCH_WINDOW / 2 + i / upsample, dx - SEARCH_WINDOW / 2 + j / upsample


def centroid(a: np.ndarray, threshold: float = 0.1) -> tuple[float, float]:
    """Of the values above threshold times the largest; the middle of an image without any."""
    top = a.max()
    weight = np.where(a > threshold * top, a, 0.0) if top > 0 else np.zeros(a.shape)
    total = weight.sum()
    if total <= 0:
        return a.shape[0] / 2, a.shape[1] / 2
    return float((weight.sum(1) * np.arange(a.shape[0])).sum() / total), float((weight.sum(0) * np.arange(a.shape[1])).sum() / total)


def pyramid(a: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [a]
    for _ in range(levels):
        out.append(gaussian_blur(out[-1], 1.0)[::2, ::2])
    return out


def pyramid_offset(reference: list[np.ndarray], target: np.ndarray) -> tuple[float, float]:
    """Coarse to fine; reference is its pyramid."""
    dy = dx = 0.0
    for ref, tgt in list(zip(reference, pyramid(target, len(reference) - 1), strict=True))[::-1]:
        dy, dx = 2 * dy, 2 * dx
        y, x, _ = phase_offset(spectrum(ref), warped(tgt, dy, dx))
        dy, dx = dy + y, dx + x
    return dy, dx


class Aligner:
    """Offsets (dy, dx) of images against one reference, whose transform is made once.

    sign="compat" keeps the sign of each method as it is: the centroid's is
    target minus reference, opposite to the others. sign="corrected" gives all
    of them the sign that warped() takes.
    """

    def __init__(self, reference: np.ndarray, method: str = "phase", sign: str = "compat", upsample: int = 20, threshold: float = 0.1, levels: int = 3):
        if method not in ("phase", "enhanced", "centroid", "gradient", "pyramid"):
            raise ValueError(f"unknown alignment method {method!r}")
        self.method, self.corrected, self.upsample, self.threshold = method, sign == "corrected", upsample, threshold
        self.shape = reference.shape
        if method == "centroid":
            self.made = centroid(reference, threshold)
        elif method == "pyramid":
            self.made = pyramid(reference, levels)
        else:
            self.made = spectrum(sobel(reference) if method == "gradient" else reference)

    def offset(self, target: np.ndarray) -> tuple[float, float, float | None]:
        if target.shape != self.shape:
            raise ValueError(f"the image is {target.shape}, the reference {self.shape}")
        if self.method == "centroid":
            y, x = centroid(target, self.threshold)
            dy, dx = y - self.made[0], x - self.made[1]
            return (-dy, -dx, None) if self.corrected else (dy, dx, None)
        if self.method == "enhanced":
            return *enhanced_offset(self.made, target, self.upsample, self.corrected), None
        if self.method == "pyramid":
            return *pyramid_offset(self.made, target), None
        return phase_offset(self.made, sobel(target) if self.method == "gradient" else target)


# --- stacks ----------------------------------------------------------------


def clipped_mean(stack: np.ndarray, sigma: float = 2.5, iterations: int = 2) -> np.ndarray:
    """Along the first axis: values beyond sigma population deviations are left
    out, again and again; where none is left, the plain mean."""
    keep = np.ones(stack.shape, dtype=bool)
    going = np.ones(stack.shape[1:], dtype=bool)
    for _ in range(iterations):
        n = keep.sum(0)
        mean = np.where(keep, stack, 0).sum(0) / np.maximum(n, 1)
        dev = np.sqrt(np.where(keep, (stack - mean) ** 2, 0).sum(0) / np.maximum(n, 1))
        going &= (dev >= 1e-10) & (n > 0)
        keep &= ~going | (np.abs(stack - mean) <= sigma * dev)
    n = keep.sum(0)
    return np.where(n > 0, np.where(keep, stack, 0).sum(0) / np.maximum(n, 1), stack.mean(0))


def stacked(stack: np.ndarray, method: str = "mean", weights: np.ndarray | None = None, sigma: float = 2.5, iterations: int = 2) -> np.ndarray:
    if method == "median":
        return np.median(stack, 0)
    if method == "sigma_clip":
        return clipped_mean(stack, sigma, iterations)
    if weights is not None and (w := np.maximum(weights, 0)).sum() >= 1e-15:
        return np.tensordot(w, stack, 1) / w.sum()
    return stack.mean(0)


def drizzle_axis(n: int, offset: float, scale: float, pixfrac: float, size: int) -> np.ndarray:
    """(n, size): how much of each output cell the drop of each input pixel covers along one axis."""
    mid = (np.arange(n) - offset) * scale
    half = pixfrac * scale / 2
    out = np.arange(size)
    return np.maximum(np.minimum(mid[:, None] + half, out + 1) - np.maximum(mid[:, None] - half, out), 0)


def drizzled(a: np.ndarray, dy: float, dx: float, scale: float = 2.0, pixfrac: float = 0.7, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(values, weights) on the finer grid: an overlap is a product of overlaps
    along the axes, so a frame is two matrix products. Pixels of 0 add no weight."""
    size = [math.ceil(n * scale) for n in a.shape]
    rows, cols = drizzle_axis(a.shape[0], dy, scale, pixfrac, size[0]), drizzle_axis(a.shape[1], dx, scale, pixfrac, size[1])
    lit = np.abs(a) >= F32_EPSILON
    return weight * (rows.T @ np.where(lit, a, 0) @ cols), weight * (rows.T @ lit.astype(float) @ cols)


def drizzle_result(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(np.where(weights > 0, values / np.where(weights > 0, weights, 1), 0), 0, 1)


# --- alignment points ------------------------------------------------------


def auto_ap_size(diameter: int) -> int:
    return min(max(diameter // 8, 32), 256) // 8 * 8


def grid_axis(n: int, ap_size: int) -> np.ndarray:
    half = ap_size // 2
    if half < 1:
        raise ValueError("an alignment point has a side of 2 or more")
    return np.arange(half, n - half + 1, half)


def ap_grid(reference: np.ndarray, ap_size: int = 64, min_brightness: float = 0.05) -> list[tuple[int, int, int]]:
    """(index, cy, cx) of the points whose squares are bright enough, in scan order."""
    half, out = ap_size // 2, []
    for cy in grid_axis(reference.shape[0], ap_size):
        for cx in grid_axis(reference.shape[1], ap_size):
            if region(reference, cy, cx, half).mean() >= min_brightness:
                out.append((len(out), int(cy), int(cx)))
    return out


def ap_weights(ap_size: int) -> np.ndarray:
    """Raised cosine, 0 at the first row and column, 1 in the middle."""
    side = ap_size // 2 * 2
    w = hann(side) if side else np.ones(0)
    return np.outer(w, w)


def blended(patches: list[tuple[int, int, np.ndarray]], shape: tuple[int, int], ap_size: int) -> np.ndarray:
    """(cy, cx, patch) laid over one another by their weights; places without weight are 0."""
    value, weight = np.zeros(shape), np.zeros(shape)
    w, half = ap_weights(ap_size), ap_size // 2
    for cy, cx, patch in patches:
        at = np.s_[cy - half : cy + half, cx - half : cx + half]
        value[at] += patch * w
        weight[at] += w
    return np.where(weight > 1e-12, value / np.where(weight > 1e-12, weight, 1), 0)


def local_patch(reference: np.ndarray, target: np.ndarray, half: int) -> np.ndarray | None:
    """The middle of target, moved onto reference; None where the match is weak.
    Both are search squares around one point."""
    dy, dx, confidence = phase_offset(spectrum(reference), target)
    if confidence < CONFIDENCE_LEAST:
        return None
    mid = target.shape[0] / 2
    at = mid + np.arange(2 * half) - half
    return bilinear(target, *np.meshgrid(at - dy, at - dx, indexing="ij"))


def shift_field(grid: list[tuple[int, int, int]], local: dict[int, tuple[float, float]], dy: float, dx: float, shape: tuple[int, int], ap_size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shift at each pixel: global plus local at the points, between them
    bilinear, outside as at the edge; points without a local shift have the
    global one. Fewer than two rows or columns of points: the global shift."""
    ys, xs = grid_axis(shape[0], ap_size), grid_axis(shape[1], ap_size)
    if len(ys) < 2 or len(xs) < 2:
        return np.full(shape, dy), np.full(shape, dx)
    known = np.zeros((2, len(ys), len(xs)))
    for i, cy, cx in grid:
        if i in local:
            known[:, np.searchsorted(ys, cy), np.searchsorted(xs, cx)] = local[i]

    def spread(axis: np.ndarray, n: int) -> np.ndarray:
        at = np.clip(np.arange(n), axis[0], axis[-1])
        lo = np.clip(np.searchsorted(axis, at, side="right") - 1, 0, len(axis) - 2)
        f = (at - axis[lo]) / (axis[lo + 1] - axis[lo])
        out = np.zeros((n, len(axis)))
        out[np.arange(n), lo], out[np.arange(n), lo + 1] = 1 - f, f
        return out

    rows, cols = spread(ys, shape[0]), spread(xs, shape[1])
    return dy + rows @ known[0] @ cols.T, dx + rows @ known[1] @ cols.T


def local_shifts(a: np.ndarray, reference: np.ndarray, grid: list[tuple[int, int, int]], dy: float, dx: float, ap_size: int, search: int) -> dict[int, tuple[float, float]]:
    half, out = ap_size // 2 + search, {}
    for i, cy, cx in grid:
        y, x, confidence = phase_offset(spectrum(region(reference, cy, cx, half)), region_shifted(a, cy, cx, half, dy, dx))
        if confidence >= CONFIDENCE_LEAST:
            out[i] = (y, x)
    return out


# --- mosaics ---------------------------------------------------------------

#: The row and column parity of red in each pattern.
RED_AT = {"rggb": (0, 0), "grbg": (0, 1), "gbrg": (1, 0), "bggr": (1, 1)}

# The four five-by-five kernels of Malvar, He and Cutler, in sixteenths.
MHC_GREEN = [[0, 0, -2, 0, 0], [0, 0, 4, 0, 0], [-2, 4, 8, 4, -2], [0, 0, 4, 0, 0], [0, 0, -2, 0, 0]]
MHC_ROW = [[0, 0, 1, 0, 0], [0, -2, 0, -2, 0], [-2, 8, 10, 8, -2], [0, -2, 0, -2, 0], [0, 0, 1, 0, 0]]
MHC_COLUMN = [[0, 0, -2, 0, 0], [0, -2, 8, -2, 0], [1, 0, 10, 0, 1], [0, -2, 8, -2, 0], [0, 0, -2, 0, 0]]
MHC_DIAGONAL = [[0, 0, -3, 0, 0], [0, 4, 0, 4, 0], [-3, 0, 12, 0, -3], [0, 4, 0, 4, 0], [0, 0, -3, 0, 0]]


def debayer(raw: np.ndarray, pattern: str, method: str = "bilinear") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, g, b). Taps outside repeat the edge, whatever its colour."""
    if pattern not in RED_AT:
        raise ValueError(f"{pattern!r} is no mosaic")
    raw = raw.astype(np.float64)
    h, w = raw.shape
    wide = np.pad(raw, 2, mode="edge")
    tap = lambda dr, dc: wide[2 + dr : 2 + dr + h, 2 + dc : 2 + dc + w]
    if method == "mhc":
        made = lambda k: np.clip(sum(v * tap(i - 2, j - 2) for i, line in enumerate(k) for j, v in enumerate(line) if v) / 16, 0, 1)
        cross, diagonal, across, along = (made(k) for k in (MHC_GREEN, MHC_DIAGONAL, MHC_ROW, MHC_COLUMN))
    else:
        across, along = (tap(0, -1) + tap(0, 1)) / 2, (tap(-1, 0) + tap(1, 0)) / 2
        cross, diagonal = (across + along) / 2, (tap(-1, -1) + tap(-1, 1) + tap(1, -1) + tap(1, 1)) / 4
    red_row = (np.arange(h) % 2 == RED_AT[pattern][0])[:, None]
    red_col = (np.arange(w) % 2 == RED_AT[pattern][1])[None, :]
    at_red, at_blue, beside = red_row & red_col, ~red_row & ~red_col, red_row & ~red_col
    green = np.where(at_red | at_blue, cross, raw)
    red = np.where(at_red, raw, np.where(at_blue, diagonal, np.where(beside, across, along)))
    blue = np.where(at_blue, raw, np.where(at_red, diagonal, np.where(beside, along, across)))
    return red, green, blue


# --- wavelets and deconvolution --------------------------------------------


def atrous(a: np.ndarray, scale: int) -> np.ndarray:
    kernel = np.zeros(4 * 2**scale + 1)
    kernel[:: 2**scale] = B3
    half = len(kernel) // 2
    for axis in (1, 0):
        n = a.shape[axis]
        a = sum(k * np.take(a, mirrored(np.arange(n) + j - half, n), axis) for j, k in enumerate(kernel) if k)
    return a


def wavelet_layers(a: np.ndarray, layers: int = 6) -> tuple[list[np.ndarray], np.ndarray]:
    out, now = [], a.astype(np.float64)
    for scale in range(layers):
        smooth = atrous(now, scale)
        out.append(now - smooth)
        now = smooth
    return out, now


def wavelet_joined(layers: list[np.ndarray], rest: np.ndarray, coefficients=(), denoise=()) -> np.ndarray:
    for i, d in enumerate(layers):
        t = denoise[i] if i < len(denoise) else 0.0
        d = np.sign(d) * np.maximum(np.abs(d) - t, 0) if t > 0 else d
        rest = rest + d * (coefficients[i] if i < len(coefficients) else 1.0)
    return np.clip(rest, 0, 1)


WAVELET_COEFFICIENTS = (1.5, 1.3, 1.2, 1.1, 1.0, 1.0)


def wavelet_sharpened(a: np.ndarray, layers: int = 6, coefficients=WAVELET_COEFFICIENTS, denoise=()) -> np.ndarray:
    return wavelet_joined(*wavelet_layers(a, layers), coefficients, denoise)


# The rational and asymptotic approximations of the Bessel function J1.
J1_NEAR = ([72362614232.0, -7895059235.0, 242396853.1, -2972611.439, 15704.48260, -30.16036606], [144725228442.0, 2300535178.0, 18583304.74, 99447.43394, 376.9991397, 1.0])
J1_FAR = ([1.0, 0.183105e-2, -0.3516396496e-4, 0.2457520174e-5, -0.240337019e-6], [0.04687499995, -0.2002690873e-3, 0.8449199096e-5, -0.88228987e-6, 0.105787412e-6])


def bessel_j1(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    poly = np.polynomial.polynomial.polyval
    near = x * poly(x * x, J1_NEAR[0]) / poly(x * x, J1_NEAR[1])
    ax = np.maximum(np.abs(x), 8.0)
    z, t = 8 / ax, ax - 0.75 * np.pi
    far = np.sqrt(2 / (np.pi * ax)) * (np.cos(t) * poly(z * z, J1_FAR[0]) - z * np.sin(t) * poly(z * z, J1_FAR[1]))
    return np.where(np.abs(x) < 8, near, np.sign(x) * far)


def psf(model: str, value: float, shape: tuple[int, int]) -> np.ndarray:
    """A point spread function around the origin, wrapped; its sum is 1. model:
    gaussian (sigma), kolmogorov (seeing) or airy (radius)."""
    wrap = lambda n: np.where(np.arange(n) <= n // 2, np.arange(n), np.arange(n) - n)
    y, x = wrap(shape[0])[:, None], wrap(shape[1])[None, :]
    if model == "gaussian":
        out = np.exp(-(x * x + y * y) / (2.0 * value * value))
    elif model == "kolmogorov":
        f = np.hypot(x / shape[1], y / shape[0])
        out = np.maximum(np.fft.ifft2(np.exp(-3.44 * (f * value / 0.98) ** (5 / 3))).real, 0)
    elif model == "airy":
        arg = np.pi * np.hypot(x, y) / value
        safe = np.where(arg < 1e-12, 1, arg)
        out = np.where(arg < 1e-12, 1.0, (2 * bessel_j1(safe) / safe) ** 2)
    else:
        raise ValueError(f"unknown point spread function {model!r}")
    return out / out.sum()


def richardson_lucy(a: np.ndarray, p: np.ndarray, iterations: int = 20) -> np.ndarray:
    seen = np.fft.fft2(p)
    out = a.astype(np.float64)
    for _ in range(iterations):
        ratio = a / (np.fft.ifft2(np.fft.fft2(out) * seen).real + 1e-10)
        out = out * np.fft.ifft2(np.fft.fft2(ratio) * seen.conj()).real  # the flipped function's spectrum is the conjugate
    return np.clip(out, 0, 1)


def wiener(a: np.ndarray, p: np.ndarray, noise: float = 0.001) -> np.ndarray:
    seen = np.fft.fft2(p)
    return np.clip(np.fft.ifft2(np.fft.fft2(a) * seen.conj() / (np.abs(seen) ** 2 + noise)).real, 0, 1)


# --- detection -------------------------------------------------------------


def otsu(a: np.ndarray) -> float:
    bins = (np.clip(a, 0, 1).astype(np.float32) * np.float32(OTSU_BINS - 1)).astype(int)
    n = np.bincount(bins.ravel(), minlength=OTSU_BINS).astype(float)
    back = n.cumsum()
    front = n.sum() - back
    sums = (n * np.arange(OTSU_BINS)).cumsum()
    ok = (back > 0) & (front > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, back * front * (sums / back - (sums[-1] - sums) / front) ** 2, 0)
    return (int(np.argmax(between)) + 0.5) / OTSU_BINS


def threshold(a: np.ndarray, method="otsu", sigmas: float = 2.0) -> float:
    """method: otsu, mean_sigma, or a number."""
    if method == "otsu":
        return otsu(a)
    return float(a.mean() + sigmas * a.std()) if method == "mean_sigma" else float(method)


def opened(mask: np.ndarray) -> np.ndarray:
    """Three by three erosion, then dilation; outside is false."""
    for every in (True, False):
        wide = np.pad(mask, 1)
        views = [wide[r : r + mask.shape[0], c : c + mask.shape[1]] for r in range(3) for c in range(3)]
        mask = np.all(views, 0) if every else np.any(views, 0)
    return mask


def labelled(mask: np.ndarray) -> np.ndarray:
    """Labels of the 4-connected components from 1, in scan order of their first pixels; 0 outside.
    Runs of each row are joined to the runs they touch in the row above."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (rows, starts), ends = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if starts[i] < ends[j] and starts[j] < ends[i]:
                a, b = sorted((top(i), top(j)))
                root[b] = a
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), dtype=np.int64)
    names: dict[int, int] = {}
    for k, (r, a, b) in enumerate(zip(rows, starts, ends, strict=True)):
        out[r, a:b] = names.setdefault(top(k), len(names) + 1)
    return out


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(label, area, min_row, max_row, min_col, max_col), the largest first, of equal ones the lower label."""
    names = labelled(mask)
    r, c = np.nonzero(names)
    k = names[r, c]
    if not len(k):
        return []
    n = int(k.max())
    area = np.bincount(k, minlength=n + 1)[1:]
    lows, highs = [np.full(n, max(mask.shape)) for _ in range(2)], [np.full(n, -1) for _ in range(2)]
    for v, low, high in zip((r, c), lows, highs, strict=True):
        np.minimum.at(low, k - 1, v)
        np.maximum.at(high, k - 1, v)
    rows = [(i + 1, int(area[i]), int(lows[0][i]), int(highs[0][i]), int(lows[1][i]), int(highs[1][i])) for i in range(n)]
    return sorted(rows, key=lambda x: (-x[1], x[0]))


def background(a: np.ndarray) -> float:
    """The upper median of a strip along the border."""
    strip = min(BORDER_STRIP, a.shape[0] // 2, a.shape[1] // 2)
    if not strip:
        return 0.0
    edge = np.ones(a.shape, dtype=bool)
    edge[strip : a.shape[0] - strip, strip : a.shape[1] - strip] = False
    v = np.sort(a[edge])
    return float(v[len(v) // 2])


def masked_centroid(a: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int], floor: float) -> tuple[float, float]:
    r0, r1, c0, c1 = box
    at = np.s_[r0 : r1 + 1, c0 : c1 + 1]
    weight = np.where(mask[at], np.maximum(a[at] - floor, 0), 0)
    total = weight.sum()
    if total <= 0:
        return (r0 + r1) / 2, (c0 + c1) / 2
    return r0 + float((weight.sum(1) * np.arange(weight.shape[0])).sum() / total), c0 + float((weight.sum(0) * np.arange(weight.shape[1])).sum() / total)


def detected(a: np.ndarray, method="otsu", sigmas: float = 2.0, blur: float = 2.5, min_area: int = 100) -> tuple[float, float, int, int, int] | None:
    """(cy, cx, width, height, area) of the largest bright object, or None if it
    is too small or touches the border."""
    if not a.size:
        return None
    smooth = gaussian_blur(a, blur)
    mask = opened(smooth > threshold(smooth, method, sigmas))
    found = components(mask)
    if not found:
        return None
    _, area, r0, r1, c0, c1 = found[0]
    if area < min_area or r0 == 0 or c0 == 0 or r1 >= a.shape[0] - 1 or c1 >= a.shape[1] - 1:
        return None
    cy, cx = masked_centroid(a, mask, (r0, r1, c0, c1), background(a))
    return cy, cx, c1 - c0 + 1, r1 - r0 + 1, area


def clipped_1d(v: np.ndarray, valid: np.ndarray, sigmas: float = 2.5, iterations: int = 3) -> None:
    """Takes out of valid what lies more than sigmas population deviations from the mean."""
    for _ in range(iterations):
        own = v[valid]
        if len(own) < 3 or own.std() < 1e-10:
            return
        valid &= np.abs(v - own.mean()) <= sigmas * own.std()


def drift(cx: np.ndarray, cy: np.ndarray, width: np.ndarray, height: np.ndarray) -> dict[str, float]:
    """Medians and ranges of detections without outliers; with fewer than two left, of all."""
    valid = np.ones(len(cx), dtype=bool)
    clipped_1d(cx, valid)
    clipped_1d(cy, valid)
    if valid.sum() < 2:
        valid[:] = True
    x, y, d = cx[valid], cy[valid], np.maximum(width, height)[valid]
    return {"median_cx": float(np.median(x)), "median_cy": float(np.median(y)), "drift_range_x": float(np.ptp(x)), "drift_range_y": float(np.ptp(y)), "median_diameter": float(np.median(d)), "valid_count": int(valid.sum())}


def crop_rect(found: dict[str, float], width: int, height: int, padding: float = 0.15, align: int = 32) -> tuple[int, int, int, int]:
    """(x, y, width, height) of a square around the object's path, within the frame."""
    size = found["median_diameter"] * (1 + 2 * padding) + max(found["drift_range_x"], found["drift_range_y"])
    side = -(-math.ceil(size) // align) * align
    w, h = min(side, width), min(side, height)
    place = lambda mid, n, most: min(max(math.floor(mid - n / 2 + 0.5), 0), most - n)
    return place(found["median_cx"], w, width), place(found["median_cy"], h, height), w, h


def sample_indices(n: int, count: int) -> list[int]:
    """count indices, evenly spread over n; one alone is the middle."""
    count = min(max(count, 1), n)
    return [n // 2] if count == 1 else [i * (n - 1) // (count - 1) for i in range(count)]


def keep_count(n: int, share: float, least: int = 1) -> int:
    """The rounded-up share of n, in single precision."""
    return min(max(int(np.ceil(np.float32(n) * np.float32(share))), least), n)
