"""Kernels against closed forms, invariants and plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackfield.functions import kernels as K

RNG = np.random.default_rng(5)


def disk(n=64, cy=30.0, cx=34.0, radius=12.0, value=0.8):
    y, x = np.mgrid[:n, :n]
    return np.where((y - cy) ** 2 + (x - cx) ** 2 <= radius**2, value, 0.0)


def scene(n=64):
    return K.gaussian_blur(RNG.random((n, n)), 1.5)


def test_sharpness():
    assert K.laplacian_variance(np.full((8, 8), 0.4)) == 0
    assert K.laplacian_variance(np.ones((2, 9))) == 0 and K.gradient_score(np.ones((2, 9))) == 0
    board = np.indices((16, 16)).sum(0) % 2.0
    assert K.laplacian_variance(board) > K.laplacian_variance(np.indices((16, 16)).sum(0) / 30)
    ramp = np.tile(np.arange(8.0), (8, 1))
    assert np.allclose(K.sobel(ramp)[1:-1, 1:-1], 8) and K.sobel(ramp)[0].sum() == 0


def test_mirror_is_not_symmetric():
    assert K.mirrored(np.array([-2, -1, 0, 7, 8, 9]), 8).tolist() == [2, 1, 0, 7, 7, 6]


def test_pointwise_filters():
    a = np.array([[0.25, 0.5], [0.75, 1.2]])
    assert np.allclose(K.stretch(a, 0, 0.5), [[0.5, 1], [1, 1]])
    assert np.allclose(K.stretch(a, 0.5, 0.5), np.clip(a - 0.5, 0, 1))
    assert np.allclose(K.gamma(a, 2.0)[0], [0.5, np.sqrt(0.5)])
    assert np.allclose(K.brightness_contrast(a, 0.1, 2.0), np.clip((a - 0.5) * 2 + 0.6, 0, 1))
    assert K.quantised(np.array([0.999999, 1.5, -1]), 255).tolist() == [254, 255, 0]


def test_blur_keeps_constants_and_unsharp_keeps_flat_parts():
    assert np.allclose(K.gaussian_blur(np.full((9, 7), 0.3), 2), 0.3)
    a = scene()
    assert np.array_equal(K.unsharp_mask(a, 1.5, 1.0, 10.0), a)
    assert K.laplacian_variance(K.unsharp_mask(a, 1.5, 1.0, 0.0)) > K.laplacian_variance(a)


@pytest.mark.parametrize("method", ["phase", "gradient", "pyramid"])
def test_offset_brings_target_onto_reference(method):
    a = scene()
    moved = K.warped(a, 3.0, -5.0)
    dy, dx, _ = K.Aligner(a, method).offset(moved)
    assert abs(dy + 3) < 0.3 and abs(dx - 5) < 0.3
    back = K.warped(moved, dy, dx)[10:-10, 10:-10]
    assert np.sqrt(((back - a[10:-10, 10:-10]) ** 2).mean()) < 0.5 * np.sqrt(((moved - a)[10:-10, 10:-10] ** 2).mean())


def test_centroid_has_the_other_sign_unless_corrected():
    a, b = disk(), disk(cy=33.0, cx=39.0)
    assert np.allclose(K.Aligner(a, "centroid").offset(b)[:2], (3, 5))
    assert np.allclose(K.Aligner(a, "centroid", "corrected").offset(b)[:2], (-3, -5))
    assert K.centroid(np.zeros((8, 6))) == (4, 3)


def test_enhanced_phase_as_is_and_corrected():
    a = scene()
    moved = K.warped(a, 3.0, 5.0)
    assert np.allclose(K.Aligner(a, "enhanced", "corrected").offset(moved)[:2], (-3, -5), atol=0.1)  # steps of 0.05
    as_is = K.Aligner(a, "enhanced").offset(moved)
    assert abs(as_is[0] + 3) < 1 and abs(as_is[1] + 5) < 1
    assert np.allclose(K.Aligner(a, "enhanced").offset(a)[:2], -0.05, atol=0.03)
    assert K.Aligner(a, "enhanced", upsample=1).offset(moved)[:2] == (-3.0, -5.0)


def test_bilinear_against_a_loop():
    a = RNG.random((6, 5))
    y, x = RNG.uniform(-2, 7, 40), RNG.uniform(-2, 7, 40)
    get = lambda r, c: a[r, c] if 0 <= r < 6 and 0 <= c < 5 else 0.0
    for v, yy, xx in zip(K.bilinear(a, y, x), y, x):
        r, c = int(np.floor(yy)), int(np.floor(xx))
        fy, fx = yy - r, xx - c
        assert np.isclose(v, get(r, c) * (1 - fy) * (1 - fx) + get(r, c + 1) * (1 - fy) * fx + get(r + 1, c) * fy * (1 - fx) + get(r + 1, c + 1) * fy * fx)


def test_clipped_mean():
    assert np.allclose(K.clipped_mean(np.array([0.5] * 9 + [1.0])[:, None, None], 2.0, 3), 0.5)
    flat = np.full((4, 2, 2), 0.3)
    assert np.allclose(K.clipped_mean(flat), 0.3)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12), st.floats(0.5, 3))
def test_clipped_mean_against_a_loop(values, sigma):
    keep = list(values)
    for _ in range(2):
        if not keep:
            break
        m = np.mean(keep)
        d = np.std(keep)
        if d < 1e-10:
            break
        keep = [v for v in keep if abs(v - m) <= sigma * d]
    want = np.mean(keep) if keep else np.mean(values)
    assert np.isclose(K.clipped_mean(np.array(values)[:, None], sigma, 2)[0], want)


def test_weighted_stack():
    s = np.array([[[0.0]], [[1.0]]])
    assert K.stacked(s, weights=np.array([1.0, 3.0]))[0, 0] == 0.75
    assert K.stacked(s, weights=np.array([-1.0, 0.0]))[0, 0] == 0.5


def test_drizzle_against_a_loop():
    a = RNG.random((4, 5))
    a[1, 2] = 0
    values, weights = K.drizzled(a, 0.3, -0.6, 2.0, 0.7, 1.5)
    v, w = np.zeros((8, 10)), np.zeros((8, 10))
    for r in range(4):
        for c in range(5):
            if a[r, c] == 0:
                continue
            y, x = (r - 0.3) * 2, (c + 0.6) * 2
            for i in range(8):
                for j in range(10):
                    o = max(min(y + 0.7, i + 1) - max(y - 0.7, i), 0) * max(min(x + 0.7, j + 1) - max(x - 0.7, j), 0)
                    v[i, j] += a[r, c] * o * 1.5
                    w[i, j] += o * 1.5
    assert np.allclose(values, v) and np.allclose(weights, w)
    assert K.drizzle_result(np.array([0.0, 3.0]), np.array([0.0, 2.0])).tolist() == [0, 1]


def test_grid_and_blend():
    a = np.ones((70, 70))
    grid = K.ap_grid(a, 32)
    assert [g[1:] for g in grid[:3]] == [(16, 16), (16, 32), (16, 48)] and len(grid) == 9
    out = K.blended([(cy, cx, np.ones((32, 32))) for _, cy, cx in grid], a.shape, 32)
    assert np.allclose(out[1:64, 1:64], 1) and out[0].sum() == 0 and out[64:].sum() == 0
    with pytest.raises(ValueError):
        K.ap_grid(a, 1)
    assert [K.auto_ap_size(d) for d in (10, 300, 520, 9999)] == [32, 32, 64, 256]


def test_shift_field():
    grid = K.ap_grid(np.ones((64, 64)), 32)
    dy, dx = K.shift_field(grid, {}, 1.0, -2.0, (64, 64), 32)
    assert np.allclose(dy, 1) and np.allclose(dx, -2)
    dy, _ = K.shift_field(grid, {g[0]: (0.5, 0.0) for g in grid}, 1.0, 0.0, (64, 64), 32)
    assert np.allclose(dy, 1.5)
    dy, _ = K.shift_field(grid, {0: (1.0, 0.0)}, 0.0, 0.0, (64, 64), 32)
    assert dy[16, 16] == 1 and dy[0, 0] == 1 and np.isclose(dy[24, 16], 0.5) and dy[48, 48] == 0


@pytest.mark.parametrize("method", ["bilinear", "mhc"])
@pytest.mark.parametrize("pattern", list(K.RED_AT))
def test_debayer_keeps_flat_colours_and_native_samples(pattern, method):
    flat = K.debayer(np.full((8, 10), 0.4), pattern, method)
    assert all(np.allclose(p, 0.4) for p in flat)
    raw = RNG.random((8, 8))
    red, _, blue = K.debayer(raw, pattern, method)
    r, c = K.RED_AT[pattern]
    assert np.array_equal(red[r::2, c::2], raw[r::2, c::2]) and np.array_equal(blue[1 - r :: 2, 1 - c :: 2], raw[1 - r :: 2, 1 - c :: 2])


def test_wavelets_join_again():
    a = scene(32)
    layers, rest = K.wavelet_layers(a, 4)
    assert np.allclose(sum(layers) + rest, a) and np.allclose(K.wavelet_joined(layers, rest), a)
    assert K.laplacian_variance(K.wavelet_sharpened(a)) > K.laplacian_variance(a)


def test_bessel_and_psf():
    assert np.allclose(K.bessel_j1(np.array([0.0, 1.0, 3.8317, 10.0, -1.0])), [0, 0.4400506, 0, 0.0434727, -0.4400506], atol=1e-5)
    for model, value in (("gaussian", 1.5), ("kolmogorov", 3.0), ("airy", 2.5)):
        p = K.psf(model, value, (32, 48))
        assert np.isclose(p.sum(), 1) and p.argmax() == 0 and np.allclose(p[1:], p[1:][::-1]) and p.min() >= 0


def test_deconvolution_sharpens():
    a = np.zeros((64, 64))
    a[20:44, 20:44] = 0.8
    p = K.psf("gaussian", 2.0, a.shape)
    soft = np.fft.ifft2(np.fft.fft2(a) * np.fft.fft2(p)).real
    for out in (K.richardson_lucy(soft, p, 20), K.wiener(soft, p, 0.001)):
        assert ((out - a) ** 2).mean() < 0.6 * ((soft - a) ** 2).mean() and out.min() >= 0 and out.max() <= 1


def test_components_against_flood_fill():
    mask = RNG.random((20, 23)) > 0.55
    seen, areas = np.zeros(mask.shape, bool), []
    for r, c in zip(*np.nonzero(mask)):
        if seen[r, c]:
            continue
        todo, n = [(r, c)], 0
        seen[r, c] = True
        while todo:
            y, x = todo.pop()
            n += 1
            for yy, xx in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= yy < 20 and 0 <= xx < 23 and mask[yy, xx] and not seen[yy, xx]:
                    seen[yy, xx] = True
                    todo.append((yy, xx))
        areas.append(n)
    found = K.components(mask)
    assert sorted(areas, reverse=True) == [f[1] for f in found] and K.labelled(mask).max() == len(areas)
    assert K.components(np.zeros((4, 4), bool)) == []


def test_opening_drops_hot_pixels():
    a = disk() > 0
    a[5, 5] = True
    out = K.opened(a)
    assert not out[5, 5] and out[30, 34] and len(K.components(out)) == 1


def test_detection():
    cy, cx, w, h, area = K.detected(disk())
    assert abs(cy - 30) < 0.3 and abs(cx - 34) < 0.3 and abs(w - 25) <= 4 and abs(h - 25) <= 4 and area > 100
    assert K.detected(np.zeros((32, 32))) is None and K.detected(disk(cy=3.0)) is None
    assert K.background(np.full((30, 30), 0.2)) == 0.2


def test_drift_and_crop():
    cx = np.array([50.0 + i for i in range(8)] + [500.0])
    d = K.drift(cx, np.full(9, 60.0), np.full(9, 20), np.full(9, 24))
    assert d["valid_count"] == 8 and d["drift_range_x"] == 7 and d["median_diameter"] == 24
    x, y, w, h = K.crop_rect(d, 128, 128)
    assert w == h == 64 and 0 <= x <= 64 and 0 <= y <= 64
    assert K.crop_rect({**d, "median_cx": 2.0}, 40, 50)[:1] == (0,)


def test_counts_in_single_precision():
    assert K.keep_count(100, 0.07) == 7 and K.keep_count(50, 0.28) == 14 and K.keep_count(3, 0.34) == 2 and K.keep_count(3, 0.0) == 1
    assert K.sample_indices(10, 4) == [0, 3, 6, 9] and K.sample_indices(9, 1) == [4] and K.sample_indices(3, 30) == [0, 1, 2]


def test_otsu_between_two_levels():
    a = np.where(np.arange(100).reshape(10, 10) < 40, 0.2, 0.7)
    assert 0.2 <= K.otsu(a) <= 0.7
    assert K.otsu(np.full((4, 4), 0.5)) == 0.5 / 256
