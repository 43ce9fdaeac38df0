"""SER files, images, configurations, runs and the command line, on generated files."""

import struct
from dataclasses import replace

import numpy as np
import pytest

from stackfield import cli
from stackfield.errors import EmptySequence, FrameIndexOutOfRange, InvalidCrop, InvalidSource
from stackfield.plans import config as C
from stackfield.plans import pipeline
from stackfield.sources import images, ser


def write(path, frames, depth=8, colour=0, little=True, stamps=None, **names):
    a = np.asarray(frames)
    head = ser.Header(a.shape[2], a.shape[1], depth, len(a), colour, little, **names)
    kind = "u1" if depth <= 8 else ("<u2" if little else ">u2")
    with open(path, "wb") as f:
        f.write(head.packed() + a.astype(kind).tobytes())
        if stamps:
            f.write(struct.pack(f"<{len(stamps)}Q", *stamps))
    return str(path), head


def jitter(n=12, size=64):
    out = np.full((n, size, size), 20)
    for i in range(n):
        dy, dx = i % 3 - 1, (i + 1) % 3 - 1
        out[i, 26 + dy : 38 + dy, 26 + dx : 38 + dx] = 255 if i % 4 == 0 else 200 if i % 4 == 2 else 120
    return out


def test_headers(tmp_path):
    path, head = write(tmp_path / "a.ser", np.arange(12).reshape(1, 3, 4), observer="Test", telescope="MyScope")
    got = ser.read_header(path)
    assert got == head and got.observer == "Test" and got.instrument is None and got.colour == "mono"
    assert ser.decoded(ser.read_frame(path, 0), got)[2, 3, 0] == np.float32(11 / 255)
    for bad in (b"", b"x" * 200, head.packed()[:100]):
        with pytest.raises(InvalidSource):
            ser.parse_header(bad)
    for bad in (replace(head, width=0), replace(head, pixel_depth=0), replace(head, pixel_depth=32)):
        with pytest.raises(InvalidSource):
            ser.parse_header(bad.packed())
    with pytest.raises(FrameIndexOutOfRange):
        ser.read_frame(path, 1)
    (tmp_path / "short.ser").write_bytes(replace(head, frame_count=2).packed() + b"0" * 12)
    with pytest.raises(InvalidSource):
        ser.read_header(str(tmp_path / "short.ser"))


@pytest.mark.parametrize("depth,little", [(8, True), (12, True), (16, True), (16, False)])
def test_reading(spark, tmp_path, depth, little):
    a = np.arange(5 * 3 * 4).reshape(5, 3, 4)
    path, _ = write(tmp_path / "a.ser", a, depth, little=little, stamps=[10, 20, 30, 40, 50])
    rows = ser.read_ser(spark, path, frames_per_partition=2).orderBy("frame_index").collect()
    assert [r["timestamp_us"] for r in rows] == [10, 20, 30, 40, 50] and rows[0]["bit_depth"] == (8 if depth == 8 else 16)
    assert np.allclose([r["pixels"] for r in rows], a.reshape(5, -1) / (2**depth - 1))


def test_filters_reach_the_reader(spark, tmp_path):
    path, head = write(tmp_path / "a.ser", np.zeros((9, 2, 2)))
    for where, want in (("frame_index = 4", [4]), ("frame_index IN (1, 7, 20)", [1, 7]), ("frame_index >= 7", [7, 8]), ("frame_index < 2 AND height = 2", [0, 1])):
        assert [r[0] for r in ser.read_ser(spark, path).filter(where).select("frame_index").orderBy("frame_index").collect()] == want
    from pyspark.sql.datasource import EqualTo

    reader = ser.SerReader(path, head, "mono", "bilinear", 4)
    assert list(reader.pushFilters([EqualTo(("frame_index",), 4)])) == []
    assert [p.indices for p in reader.partitions()] == [[4]]


def test_colours(spark, tmp_path):
    a = np.arange(2 * 2 * 9).reshape(2, 2, 9)  # two frames of 2 by 3 pixels of three values
    head = ser.Header(3, 2, 8, 2, 100)
    raw = head.packed() + a.astype("u1").tobytes()
    (tmp_path / "rgb.ser").write_bytes(raw)
    (tmp_path / "bgr.ser").write_bytes(replace(head, colour_id=101).packed() + raw[ser.HEADER.size :])
    r = ser.read_ser(spark, str(tmp_path / "rgb.ser"), "colour").orderBy("frame_index").first()
    s = ser.read_ser(spark, str(tmp_path / "bgr.ser"), "colour").orderBy("frame_index").first()
    assert r["r"] == s["b"] and r["b"] == s["r"] and np.allclose(r["g"], a[0].reshape(-1, 3)[:, 1] / 255)
    assert ser.read_ser(spark, str(tmp_path / "rgb.ser")).orderBy("frame_index").first()["pixels"] == r["g"]
    path, _ = write(tmp_path / "bayer.ser", np.full((1, 8, 8), 51), colour=8)
    assert np.allclose(ser.read_ser(spark, path, "colour", method="mhc").first()["b"], 0.2)
    mono, _ = write(tmp_path / "m.ser", np.zeros((1, 2, 2)))
    with pytest.raises(Exception, match="no colour"):
        ser.read_ser(spark, mono, "colour").collect()


def test_crop_is_exact(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 4096, (4, 10, 12))
    path, _ = write(tmp_path / "a.ser", a, 12, stamps=[1, 2, 3, 4])
    assert ser.crop_ser(spark, path, str(tmp_path / "b.ser"), (3, 2, 5, 6)) == (3, 2, 5, 6)
    got = ser.read_ser(spark, str(tmp_path / "b.ser")).orderBy("frame_index").collect()
    assert np.allclose([r["pixels"] for r in got], a[:, 2:8, 3:8].reshape(4, -1) / 4095) and got[3]["timestamp_us"] == 4
    bayer, _ = write(tmp_path / "c.ser", a, 12, 8)
    assert ser.crop_ser(spark, bayer, str(tmp_path / "d.ser"), (3, 3, 5, 7)) == (2, 2, 4, 6)
    assert ser.read_ser(spark, str(tmp_path / "d.ser"), "raw").first()["timestamp_us"] is None
    with pytest.raises(InvalidCrop):
        ser.crop_ser(spark, path, str(tmp_path / "e.ser"), (8, 8, 8, 8))


def test_images(tmp_path):
    rng = np.random.default_rng(2)
    for n in (1, 3):
        a = rng.random((7, 5, n)).astype(np.float32)
        planes = [a[..., i] for i in range(n)]
        for name, step in (("x.png", 1 / 255), ("x.tiff", 1 / 65535), ("x.other", 1 / 65535)):
            images.save(str(tmp_path / name), *planes)
            b = images.load(str(tmp_path / name))
            assert b.shape == a.shape and (a - b).max() <= step * 1.01 and (a - b).min() >= -1e-6
            assert images.is_colour(str(tmp_path / name)) == (n == 3)
    with pytest.raises(InvalidSource):
        images.read_tiff(b"nothing at all")
    assert images.display(np.ones((20, 10)), 10).shape == (10, 5)


def test_png_line_filters():
    """A PNG whose lines use all five filters reads as the plain one."""
    import zlib

    a = np.random.default_rng(4).integers(0, 256, (5, 6)).astype(np.uint8)
    lines, above = [], np.zeros(6, int)
    for y, row in enumerate(a.astype(int)):
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][y]
        lines.append(bytes([y]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    plain = images.png_bytes(a / 255.0)
    at = plain.index(b"IDAT")
    data = zlib.compress(b"".join(lines))
    chunk = struct.pack(">I", len(data)) + b"IDAT" + data + struct.pack(">I", zlib.crc32(b"IDAT" + data))
    n = struct.unpack(">I", plain[at - 4 : at])[0]
    assert np.allclose(images.read_png(plain[: at - 4] + chunk + plain[at + 8 + n :])[..., 0], a / 255)


def test_config_round_trip():
    c = C.Config(input='a "b".ser', stack="drizzle", filters=[{"name": "gamma", "value": 2.0}], denoise=[0.1])
    assert C.loads(C.dumps(c)) == c and C.loads("") == C.Config()
    for bad in ('stack = "pile"', "colour = 1"):
        with pytest.raises(ValueError):
            C.loads(bad)
    assert C.number_list("1, x,2") == [1, 2]
    with pytest.raises(ValueError):
        C.number_list("1,x", strict=True)


@pytest.mark.parametrize("method", ["mean", "median", "sigma_clip", "drizzle", "multi_point", "surface_warp"])
def test_runs(spark, tmp_path, method):
    path, _ = write(tmp_path / "a.ser", jitter())
    c = C.Config(input=path, output=str(tmp_path / "o.png"), stack=method, ap_size=16, search_radius=4, sharpen=True, filters=[{"name": "gamma", "value": 1.2}], deconvolution="wiener")
    pipeline.save(pipeline.run(spark, c), c.output)
    out = images.load(c.output)
    side = 128 if method == "drizzle" else 64
    assert out.shape == (side, side, 1) and out[side // 2, side // 2, 0] > out[side // 8, side // 8, 0] + 0.2


def test_points_are_sized_by_the_object(spark, tmp_path):
    path, _ = write(tmp_path / "a.ser", jitter())
    frames = ser.read_ser(spark, path)
    chosen = pipeline.sized(frames, C.Config(input=path, stack="multi_point", ap_size=0))
    assert chosen.ap_size == 32 and pipeline.sized(frames, C.Config(input=path, stack="multi_point", ap_size=24)).ap_size == 24


@pytest.mark.parametrize("method", ["mean", "drizzle", "multi_point", "surface_warp"])
def test_colour_runs(spark, tmp_path, method):
    path, _ = write(tmp_path / "a.ser", jitter(6), colour=8)
    c = C.Config(input=path, output=str(tmp_path / "o.tiff"), stack=method, ap_size=16, search_radius=4, select=0.5)
    pipeline.save(pipeline.run(spark, c), c.output)
    assert images.load(c.output).shape[2] == 3
    mono = pipeline.run(spark, replace(c, force_mono=True))
    assert "pixels" in mono.columns


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.ser").write_bytes(ser.Header(4, 4, 8, 0).packed())
    with pytest.raises(EmptySequence):
        pipeline.run(spark, C.Config(input=str(tmp_path / "e.ser")))


def test_command_line(spark, tmp_path, capsys):
    path, _ = write(tmp_path / "a.ser", jitter(8))
    assert cli.main(["info", path]) == 0 and "frame_count: 8" in capsys.readouterr().out
    assert cli.main(["quality", path, "--top", "2"]) == 0 and capsys.readouterr().out.count("\n") == 3
    out = str(tmp_path / "s.tiff")
    assert cli.main(["stack", path, out, "--select", "50"]) == 0 and images.load(out).shape == (64, 64, 1)
    assert cli.main(["sharpen", out, str(tmp_path / "t.png"), "--deconvolution", "richardson_lucy"]) == 0
    assert cli.main(["filter", out, str(tmp_path / "u.png"), "--stretch", "auto", "--gamma", "1.5", "--unsharp", "1,0.5,0", "--blur", "1"]) == 0
    assert cli.main(["config", "--output", str(tmp_path / "c.toml")]) == 0
    assert cli.main(["run", path, str(tmp_path / "r.png"), "--config", str(tmp_path / "c.toml")]) == 0 and (tmp_path / "r.png").exists()
    assert cli.main(["run", path, str(tmp_path / "q.png"), "--method", "mean", "--sharpen", "1.5,1.2", "--auto-stretch"]) == 0
    y, x = np.mgrid[:128, :128]
    disk, _ = write(tmp_path / "d.ser", [np.where((y - 60) ** 2 + (x - 50 - i) ** 2 <= 144, 200, 0) for i in range(5)])
    assert cli.main(["auto-crop", disk]) == 0 and "64x64" in capsys.readouterr().out
    assert cli.main(["info", str(tmp_path / "none.ser")]) == 1
