"""Operators on small captures of known content, against the kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackfield import queries
from stackfield.functions import kernels as K
from stackfield.functions import sql
from stackfield.operators import align, detect, filters, multipoint, quality, stack
from stackfield.schema import FRAMES, interleaved_to_planes, planes_to_interleaved, to_frames, to_pixels
from stackfield.streaming.live import live_mean

RNG = np.random.default_rng(3)


def frames_of(spark, arrays, **columns):
    rows = [(i, a.shape[0], a.shape[1], 8, None, a.astype(np.float32).ravel().tolist()) for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, FRAMES)
    for k, v in columns.items():
        df = df.withColumn(k, F.element_at(F.array(*map(F.lit, v)), (F.col("frame_index") + 1).cast("int")))
    return df


def array_of(row, column="pixels"):
    return np.array(row[column]).reshape(row["height"], row["width"])


@pytest.fixture(scope="module")
def jitter():
    """A bright square that moves by a pixel, more or less sharp."""
    out = []
    for i in range(12):
        a = np.full((64, 64), 0.08)
        dy, dx = i % 3 - 1, (i + 1) % 3 - 1
        a[24 + dy : 40 + dy, 24 + dx : 40 + dx] = 0.8 + 0.05 * (i % 4 == 0)
        a[28 + dy : 32 + dy, 30 + dx : 37 + dx] = 0.4
        out.append(K.gaussian_blur(a, 0.6 + 0.2 * (i % 4)))
    return out


def test_ranks_break_ties_by_index(spark):
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0), (3, 2.0)], "frame_index long, score double")
    assert [r["frame_index"] for r in quality.rank_frames(s).orderBy("rank").collect()] == [1, 3, 0, 2]
    assert {r["frame_index"] for r in quality.select_fraction(s, 0.5).collect()} == {1, 3}
    assert quality.select_fraction(s, 0.0).count() == 1 and quality.select_fraction(s, 0.0, least=0).count() == 0
    assert quality.select_fraction(s.limit(0), 0.5).count() == 0


def test_frames_of_a_capture_have_one_size(spark):
    mixed = frames_of(spark, [np.ones((4, 4))]).unionByName(frames_of(spark, [np.ones((4, 6))]))
    for out in (stack.mean_stack(mixed), stack.robust_stack(mixed), stack.drizzle_stack(mixed.withColumns({"dy": F.lit(0.0), "dx": F.lit(0.0)}))):
        with pytest.raises(Exception, match="differ in size"):
            out.collect()
    assert stack.mean_stack(mixed.limit(0)).count() == 0 and stack.robust_stack(mixed.limit(0)).count() == 0
    assert len(stack.mean_stack(mixed.withColumn("side", F.col("width")), ("side",)).collect()) == 2


def test_tiles_shrink_to_one_pixel():
    assert [stack.tile_size(n) for n in (0, 1000, 10**6, 10**9)] == [65_536, 8000, 8, 1]


def test_selection_counts_in_single_precision(spark):
    s = spark.range(100).select(F.col("id").alias("frame_index"), F.rand(1).alias("score"))
    assert quality.select_fraction(s, 0.07).count() == 7


def test_scores_of_colour_are_those_of_luminance(spark, jitter):
    f = frames_of(spark, jitter[:2]).select("frame_index", "height", "width", *(F.col("pixels").alias(c) for c in "rgb"))
    got = [r["score"] for r in quality.score_colour(f).orderBy("frame_index").collect()]
    assert np.allclose(got, [K.laplacian_variance(a) for a in jitter[:2]], atol=1e-7)


@pytest.mark.parametrize("method", ["mean", "median", "sigma_clip"])
def test_stacks_against_numpy(spark, method):
    a = RNG.random((9, 7, 11))
    f = frames_of(spark, a, capture=["x"] * 4 + ["y"] * 5).repartition(3)
    out = stack.mean_stack(f, ("capture",)) if method == "mean" else stack.robust_stack(f, method, ("capture",), tile=10)
    for r in out.collect():
        own = a[:4] if r["capture"] == "x" else a[4:]
        assert r["n"] == len(own) and np.allclose(array_of(r), K.stacked(own, method), atol=1e-6)


def test_tiles_of_sums_come_together(spark, monkeypatch):
    monkeypatch.setattr(stack, "TILE", 16)
    a = RNG.random((5, 9, 8))
    assert np.allclose(array_of(stack.mean_stack(frames_of(spark, a).repartition(2)).first()), a.mean(0), atol=1e-6)


def test_weighted_mean_and_drizzle(spark):
    a = RNG.random((4, 6, 6))
    f = frames_of(spark, a, w=[1.0, 2.0, -1.0, 0.5], dy=[0.0, 0.3, -0.4, 0.1], dx=[0.0, -0.2, 0.6, 0.0])
    assert np.allclose(array_of(stack.mean_stack(f, weight="w").first()), K.stacked(a, weights=np.array([1, 2, -1, 0.5])), atol=1e-6)
    for sign in ("compat", "corrected"):
        t = -1 if sign == "corrected" else 1
        parts = [K.drizzled(x.astype(np.float32).astype(float), t * y, t * z) for x, y, z in zip(a, (0, 0.3, -0.4, 0.1), (0, -0.2, 0.6, 0))]
        want = K.drizzle_result(sum(p[0] for p in parts), sum(p[1] for p in parts))
        assert np.allclose(array_of(stack.drizzle_stack(f, sign=sign).first()), want, atol=1e-6)
    with pytest.raises(ValueError):
        stack.drizzle_stack(f, pixfrac=0)


def test_alignment_lowers_the_difference(spark, jitter):
    f = frames_of(spark, jitter)
    ref = f.filter("frame_index = 0").select("pixels")
    for method in ("phase", "enhanced", "gradient", "pyramid", "centroid"):
        moved = align.align(f.withColumn("own", F.lit(0).cast("long")), ref, method=method, sign="corrected", reference_index="own").orderBy("frame_index").collect()
        was = np.mean([((a - jitter[0]) ** 2).mean() for a in jitter[1:]])
        now = np.mean([((array_of(r) - jitter[0])[4:-4, 4:-4] ** 2).mean() for r in moved[1:]])
        assert now < 0.5 * was, method
        assert np.allclose(array_of(moved[0]), jitter[0], atol=1e-6)


def test_drizzle_with_phase_offsets_needs_the_corrected_sign(spark, jitter):
    f = frames_of(spark, jitter)
    off = align.offsets(f, f.filter("frame_index = 0").select("pixels")).select("frame_index", "dy", "dx")
    sharp = [K.laplacian_variance(array_of(stack.drizzle_stack(f.join(off, "frame_index"), pixfrac=1.0, sign=s).first())) for s in ("compat", "corrected")]
    assert sharp[1] > sharp[0]


def test_offsets_by_capture(spark, jitter):
    f = frames_of(spark, jitter[:6], capture=["a"] * 3 + ["b"] * 3)
    ref = f.groupBy("capture").agg(F.min_by("pixels", "frame_index").alias("pixels"))
    got = {r["frame_index"]: (r["dy"], r["dx"]) for r in align.offsets(f, ref, ("capture",)).collect()}
    assert got[0] == got[3] == (0, 0)
    assert np.allclose(got[4], K.Aligner(jitter[3].astype(np.float32).astype(float)).offset(jitter[4].astype(np.float32).astype(float))[:2])


@pytest.mark.parametrize("local", ["mean", "median", "sigma_clip"])
def test_multi_point(spark, jitter, local):
    r = multipoint.multi_point_stack(frames_of(spark, jitter), ap_size=16, search_radius=4, select=0.5, local=local).first()
    out = array_of(r)
    assert out.shape == (64, 64) and np.isfinite(out).all() and out[0].sum() == 0
    assert np.corrcoef(out[8:56, 8:56].ravel(), jitter[0][8:56, 8:56].ravel())[0, 1] > 0.9


def test_surface_warp(spark, jitter):
    out = array_of(multipoint.surface_warp_stack(frames_of(spark, jitter), ap_size=16, search_radius=4, select=0.5).first())
    assert np.corrcoef(out.ravel(), jitter[0].ravel())[0, 1] > 0.95


@pytest.fixture(scope="module")
def coloured(jitter):
    """Channels that move by other steps than the luminance, so that each by itself would be aligned otherwise."""
    return [(a, np.roll(a, i % 2, 1) * 0.9, np.roll(a, (i + 1) % 3, 0) * 0.5) for i, a in enumerate(jitter)]


def colour_frames(spark, triples):
    rows = [(i, *r.shape, *(x.astype(np.float32).ravel().tolist() for x in (r, g, b))) for i, (r, g, b) in enumerate(triples)]
    return spark.createDataFrame(rows, "frame_index long, height int, width int, r array<float>, g array<float>, b array<float>")


def looped_colour(triples, ap, radius, share, warp):
    """Frame by frame on the luminance, as the definition has it."""
    planes = [[x.astype(np.float32).astype(float) for x in t] for t in triples]
    grey = [K.luminance(*t) for t in planes]
    offsets = [(0.0, 0.0)] + [K.Aligner(grey[0]).offset(a)[:2] for a in grey[1:]]
    best = lambda scores, part: sorted(range(len(scores)), key=lambda i: (-scores[i], i))[: max(1, int(np.ceil(len(scores) * part)))]
    scores = [K.quality(a, "laplacian") for a in grey]
    known = np.mean([K.warped(grey[i], *offsets[i]).astype(np.float32).astype(float) for i in best(scores, 0.2)], 0).astype(np.float32).astype(float)
    grid, half = K.ap_grid(known, ap, 0.05), ap // 2
    if warp:
        chosen, total = best(scores, share), np.zeros((3, *known.shape))
        for i in chosen:
            field = K.shift_field(grid, K.local_shifts(grey[i], known, grid, *offsets[i], ap, radius), *offsets[i], known.shape, ap)
            total += scores[i] * np.array([K.warped(a, *field) for a in planes[i]])
        return total / sum(scores[i] for i in chosen)
    stacks = []
    for _, cy, cx in grid:
        own = [K.quality(K.region_shifted(a, cy, cx, half, *o), "laplacian") for a, o in zip(grey, offsets)]
        patches, weights = [], []
        for i in best(own, share):
            y, x, sure = K.phase_offset(K.spectrum(K.region(known, cy, cx, half + radius)), K.region_shifted(grey[i], cy, cx, half + radius, *offsets[i]))
            if sure >= K.CONFIDENCE_LEAST:
                patches.append([K.region_shifted(a, cy, cx, half, offsets[i][0] + y, offsets[i][1] + x) for a in planes[i]])
                weights.append(own[i])
        three = [K.stacked(np.array([p[c] for p in patches]), "mean", np.array(weights), 2.5, 2) if patches else K.region(known, cy, cx, half) for c in range(3)]
        stacks.append((cy, cx, three))
    return [K.blended([(cy, cx, t[c]) for cy, cx, t in stacks], known.shape, ap) for c in range(3)]


@pytest.mark.parametrize("made", [multipoint.multi_point_stack_colour, multipoint.surface_warp_stack_colour])
def test_colour_stacks_follow_the_luminance(spark, coloured, made):
    warp = made is multipoint.surface_warp_stack_colour
    row = made(colour_frames(spark, coloured), ap_size=16, search_radius=4, select=0.5).first()
    for c, want in zip("rgb", looped_colour(coloured, 16, 4, 0.5, warp), strict=True):
        assert np.allclose(array_of(row, c), want, atol=2e-5), c
    alone = multipoint.surface_warp_stack if warp else multipoint.multi_point_stack
    by_itself = array_of(alone(frames_of(spark, [t[2] for t in coloured]), ap_size=16, search_radius=4, select=0.5).first())
    assert np.abs(by_itself - array_of(row, "b")).max() > 0.02


@pytest.mark.parametrize("made", [multipoint.multi_point_stack, multipoint.surface_warp_stack])
def test_captures_are_stacked_each_by_itself(spark, jitter, made):
    turned = [np.ascontiguousarray(a.T)[::-1] for a in jitter[2:]]
    both = frames_of(spark, jitter).withColumn("label", F.lit("a")).unionByName(frames_of(spark, turned).withColumn("label", F.lit("b")))
    out = {r["label"]: array_of(r) for r in made(both, ap_size=16, search_radius=4, select=0.5, keys=("label",)).collect()}
    for label, arrays in (("a", jitter), ("b", turned)):
        assert np.allclose(out[label], array_of(made(frames_of(spark, arrays), ap_size=16, search_radius=4, select=0.5).first()), atol=1e-6)


@pytest.mark.parametrize("name", ["multi_point_stack", "surface_warp_stack"])
def test_stacks_of_points_have_all_captures(spark, name):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES[name](spark, sf).groupBy("label").count().collect()
    labels = {r["label"] for r in queries.captures(spark, sf).select("label").distinct().collect()}
    assert {r["label"] for r in rows} == labels and len(labels) > 1 and {r["count"] for r in rows} == {1024}


def test_dark_frames_have_no_points(spark):
    with pytest.raises(Exception, match="no alignment points"):
        multipoint.multi_point_stack(frames_of(spark, [np.zeros((32, 32))] * 3), ap_size=16)


def test_filters_against_kernels(spark):
    a = RNG.random((1, 9, 8)).astype(np.float32)
    f = frames_of(spark, a)
    x = a[0].astype(float)
    cases = [
        (filters.histogram_stretch(f, 0.2, 0.7), K.stretch(x, 0.2, 0.7)), (filters.gamma(f, 1.8), K.gamma(x, 1.8)), (filters.brightness_contrast(f, 0.1, 1.3), K.brightness_contrast(x, 0.1, 1.3)),
        (filters.auto_stretch(f), K.auto_stretch(x)), (filters.gaussian_blur(f, 1.2), K.gaussian_blur(x, 1.2)), (filters.unsharp_mask(f, 1.0, 0.5, 0.01), K.unsharp_mask(x, 1.0, 0.5, 0.01)),
        (filters.wavelet_sharpen(f, 3), K.wavelet_sharpened(x, 3)), (filters.deconvolve(f, psf="kolmogorov", iterations=3), K.richardson_lucy(x, K.psf("kolmogorov", 2.0, x.shape), 3)),
        (filters.crop(f, 2, 1, 4, 5), x[1:6, 2:6]), (filters.apply_filters(f, [("gamma", {"value": 2.0}), ("gaussian_blur", {"sigma": 1.0})]), K.gaussian_blur(K.gamma(x, 2.0), 1.0)),
    ]
    for df, want in cases:
        assert np.allclose(array_of(df.first()), want, atol=1e-6)
    with pytest.raises(ValueError):
        filters.apply_filters(f, [("sparkle", {})])


def test_rgb_align(spark):
    g = K.gaussian_blur(RNG.random((48, 48)), 1.5)
    row = (0, 48, 48, K.warped(g, 2, -1).ravel().tolist(), g.ravel().tolist(), K.warped(g, -1, 3).ravel().tolist())
    f = spark.createDataFrame([row], "frame_index long, height int, width int, r array<float>, g array<float>, b array<float>")
    r = filters.rgb_align(f).first()
    assert np.allclose((r["red_dy"], r["red_dx"], r["blue_dy"], r["blue_dx"]), (-2, 1, 1, -3), atol=0.3)
    r = filters.rgb_align(f, (-2.0, 1.0), (1.0, -3.0)).first()
    assert np.allclose(array_of(r, "r")[6:-6, 6:-6], g[6:-6, 6:-6], atol=1e-4)


def test_layouts(spark):
    a = RNG.random((2, 4, 6)).astype(np.float32)
    f = frames_of(spark, a)
    back = to_frames(to_pixels(f, "frame_index"), "frame_index").orderBy("frame_index").collect()
    assert all(np.allclose(array_of(r), x) for r, x in zip(back, a))
    again = planes_to_interleaved(interleaved_to_planes(f)).orderBy("frame_index").collect()
    assert all(np.allclose(array_of(r), x) for r, x in zip(again, a))


def test_auto_crop_contains_the_path(spark):
    y, x = np.mgrid[:128, :128]
    f = frames_of(spark, [np.where((y - 60 - i) ** 2 + (x - 50 - i) ** 2 <= 144, 0.8, 0.0) for i in range(10)])
    cx, cy, w, h = detect.auto_crop(f)
    assert w == h and w % 32 == 0 and cx <= 38 and cx + w >= 72 and cy <= 48 and cy + h >= 82
    few = frames_of(spark, [np.where((y - 60) ** 2 + (x - 50) ** 2 <= 144, 0.8, 0.0) if 8 <= i < 12 else np.zeros((128, 128)) for i in range(20)])
    assert detect.auto_crop(few, sample_count=4)[2] >= 32  # no detection in the sample: the middle frames decide
    with pytest.raises(Exception, match="no object"):
        detect.auto_crop(frames_of(spark, [np.zeros((64, 64))] * 3))
    with pytest.raises(Exception, match="no frames"):
        detect.auto_crop(f.limit(0))


def test_crop_rectangles():
    assert detect.validated_crop((3, 5, 9, 7), 64, 64, bayer=True) == (2, 4, 8, 6)
    for bad in ((0, 0, 0, 4), (60, 0, 8, 8), (-1, 0, 4, 4)):
        with pytest.raises(Exception):
            detect.validated_crop(bad, 64, 64)
    assert detect.aspect_snapped(100, 60, "16:9") == (100, 56) and detect.aspect_snapped(100, 60, "1:1") == (60, 60) and detect.aspect_snapped(9, 4) == (9, 4)


def test_sql_functions(spark):
    sql.register(spark)
    a = RNG.random((2, 8, 8)).astype(np.float32)
    frames_of(spark, a).createOrReplaceTempView("captured")
    rows = spark.sql("SELECT laplacian_variance(pixels, height, width) l, gradient_score(pixels, height, width) g, phase_offset(pixels, pixels, height, width).dy dy FROM captured ORDER BY frame_index").collect()
    assert np.allclose([r["l"] for r in rows], [K.laplacian_variance(x) for x in a]) and rows[0]["dy"] == 0
    made = {"histogram_stretch(p, 0.1, 0.8)": K.stretch(a[0], 0.1, 0.8), "gamma_image(p, 2.2)": K.gamma(a[0], 2.2), "brightness_contrast(p, 0.1, 1.5)": K.brightness_contrast(a[0], 0.1, 1.5), "gaussian_blur(p, 1.0)": K.gaussian_blur(a[0], 1.0), "unsharp_mask(p, 1.5, 0.8, 0.05)": K.unsharp_mask(a[0].astype(np.float64), 1.5, 0.8, 0.05)}
    calls = ", ".join(f"{c.replace('(p', '(pixels, height, width')} c{i}" for i, c in enumerate(made))
    row = spark.sql(f"SELECT {calls}, image_centroid(pixels, height, width, 0.1) m FROM captured WHERE frame_index = 0").first()
    assert all(np.allclose(row[i], want.ravel(), atol=1e-6) for i, want in enumerate(made.values())) and np.allclose(row["m"], K.centroid(a[0].astype(np.float64)))


def test_live_mean(spark, tmp_path):
    a = RNG.random((5, 3, 4)).astype(np.float32)
    src = str(tmp_path / "in")
    f = frames_of(spark, a, capture=["x", "x", "y", "x", "y"])
    f.filter("frame_index < 3").coalesce(1).write.parquet(src)
    f.filter("frame_index >= 3").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live_mean(stream, "capture").writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    best = {r["capture"]: r for r in spark.sql("SELECT * FROM live ORDER BY n").collect()}
    assert best["x"]["n"] == 3 and np.allclose(array_of(best["x"]), a[[0, 1, 3]].mean(0)) and np.allclose(array_of(best["y"]), a[[2, 4]].mean(0))
