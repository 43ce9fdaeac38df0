"""Command line: info, quality, stack, sharpen, filter, run, config, auto-crop."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from .errors import StackfieldError
from .functions import kernels as K
from .operators import detect, quality
from .plans import config as C
from .plans import pipeline
from .sources import images, ser


def session() -> SparkSession:
    return SparkSession.builder.appName("stackfield").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _grey(path: str) -> np.ndarray:
    a = images.load(path).astype(np.float64)
    return a[..., 0] if a.shape[2] == 1 else K.luminance(a[..., 0], a[..., 1], a[..., 2])


def _stack_options(p: argparse.ArgumentParser, method: str) -> None:
    p.add_argument("--method", default=method, choices=["mean", "median", "sigma_clip", "multi_point", "drizzle", "surface_warp"])
    p.add_argument("--select", type=float, default=25.0, help="percent of frames to keep")
    p.add_argument("--metric", default="laplacian", choices=["laplacian", "gradient"])
    p.add_argument("--sigma", type=float, default=2.5)
    p.add_argument("--iterations", type=int, default=2)
    p.add_argument("--ap-size", type=int, default=64, help="side of an alignment point; 0: from the detected object")
    p.add_argument("--search-radius", type=int, default=16)
    p.add_argument("--min-brightness", type=float, default=0.05)
    p.add_argument("--scale", type=float, default=2.0)
    p.add_argument("--pixfrac", type=float, default=0.7)
    p.add_argument("--sign", default="compat", choices=["compat", "corrected"])


def _sharpen_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--deconvolution", default="", choices=["", "richardson_lucy", "wiener"])
    p.add_argument("--psf", default="gaussian", choices=["gaussian", "kolmogorov", "airy"])
    p.add_argument("--psf-value", type=float, default=2.0)
    p.add_argument("--rl-iterations", type=int, default=20)
    p.add_argument("--wiener-noise", type=float, default=0.001)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stackfield")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("info").add_argument("input")
    p = sub.add_parser("quality")
    p.add_argument("input")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--metric", default="laplacian", choices=["laplacian", "gradient"])
    p = sub.add_parser("stack")
    p.add_argument("input")
    p.add_argument("output")
    _stack_options(p, "mean")
    p = sub.add_parser("sharpen")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--layers", type=int, default=6)
    p.add_argument("--coefficients", default="1.5,1.3,1.2,1.1,1.0,1.0")
    p.add_argument("--denoise", default="")
    _sharpen_options(p)
    p = sub.add_parser("filter")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--stretch", help="black,white or auto")
    p.add_argument("--gamma", type=float)
    p.add_argument("--brightness", type=float, default=0.0)
    p.add_argument("--contrast", type=float, default=1.0)
    p.add_argument("--unsharp", help="radius,amount,threshold")
    p.add_argument("--blur", type=float)
    p = sub.add_parser("run")
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("--config", help="a TOML file; only input and output override it")
    _stack_options(p, "multi_point")
    _sharpen_options(p)
    p.add_argument("--align", default="phase", choices=["phase", "enhanced", "centroid", "gradient", "pyramid"])
    p.add_argument("--debayer", default="auto", choices=["auto", "off", "bilinear", "mhc"])
    p.add_argument("--force-mono", action="store_true")
    p.add_argument("--sharpen", help="coefficients, one for each layer")
    p.add_argument("--gamma", type=float)
    p.add_argument("--auto-stretch", action="store_true")
    p = sub.add_parser("config")
    p.add_argument("--output")
    p = sub.add_parser("auto-crop")
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--samples", type=int, default=30)
    p.add_argument("--padding", type=float, default=0.15)
    p.add_argument("--threshold", default="mean_sigma", help="otsu, mean_sigma or a number")
    p.add_argument("--min-area", type=int, default=100)
    return top


def _stack_config(a: argparse.Namespace, **more) -> C.Config:
    return C.Config(input=a.input, output=a.output, stack=a.method, metric=a.metric, sigma=a.sigma, iterations=a.iterations, ap_size=a.ap_size, search_radius=a.search_radius, min_brightness=a.min_brightness, scale=a.scale, pixfrac=a.pixfrac, sign=a.sign, **more)


def run_config(a: argparse.Namespace) -> C.Config:
    if a.config:
        made = C.loads(Path(a.config).read_text())
        made.input, made.output = a.input or made.input, a.output or made.output
        return made
    steps = ([{"name": "auto_stretch"}] if a.auto_stretch else []) + ([{"name": "gamma", "value": a.gamma}] if a.gamma else [])
    sharp = C.number_list(a.sharpen) if a.sharpen else []
    more = {"sharpen": True, "coefficients": sharp, "layers": len(sharp)} if sharp else {}
    return _stack_config(a, select=a.select / 100, align=a.align, debayer=a.debayer, force_mono=a.force_mono, deconvolution=a.deconvolution, psf=a.psf, psf_value=a.psf_value, rl_iterations=a.rl_iterations, wiener_noise=a.wiener_noise, filters=steps, **more)


def filtered(a: np.ndarray, o: argparse.Namespace) -> np.ndarray:
    """Stretch, gamma, brightness and contrast, unsharp mask, blur: in this order."""
    if o.stretch == "auto":
        a = K.auto_stretch(a)
    elif o.stretch:
        a = K.stretch(a, *C.number_list(o.stretch, True))
    if o.gamma:
        a = K.gamma(a, o.gamma)
    if o.brightness or o.contrast != 1:
        a = K.brightness_contrast(a, o.brightness, o.contrast)
    if o.unsharp:
        a = K.unsharp_mask(a, *C.number_list(o.unsharp, True))
    return K.gaussian_blur(a, o.blur) if o.blur else a


def sharpened(a: np.ndarray, o: argparse.Namespace) -> np.ndarray:
    if o.deconvolution:
        p = K.psf(o.psf, o.psf_value, a.shape)
        a = K.richardson_lucy(a, p, o.rl_iterations) if o.deconvolution == "richardson_lucy" else K.wiener(a, p, o.wiener_noise)
    return K.wavelet_sharpened(a, o.layers, C.number_list(o.coefficients, True), C.number_list(o.denoise, True) if o.denoise else ())


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "info":
            for k, v in ser.info(session(), a.input).first().asDict().items():
                print(f"{k}: {v}")
        elif a.command == "quality":
            scores = quality.score_frames(ser.read_ser(session(), a.input), a.metric).persist()
            s = quality.summary(scores).first()
            print(f"{s['n_frames']} frames, best {s['best_score']:.6g}, worst {s['worst_score']:.6g}")
            for rank, r in enumerate(quality.top_n(scores, a.top).collect(), 1):
                print(f"{rank}\t{r['frame_index']}\t{r['score']:.6g}")
        elif a.command == "stack":
            made = _stack_config(a, select=min(max(a.select / 100, 0.01), 1.0), force_mono=True)
            pipeline.save(pipeline.run(session(), made), a.output)
        elif a.command == "sharpen":
            images.save(a.output, sharpened(_grey(a.input), a))
        elif a.command == "filter":
            images.save(a.output, filtered(_grey(a.input), a))
        elif a.command == "run":
            made = run_config(a)
            pipeline.save(pipeline.run(session(), made), made.output)
        elif a.command == "config":
            text = C.dumps(C.Config())
            Path(a.output).write_text(text) if a.output else print(text, end="")
        else:
            spark, head = session(), ser.read_header(a.input)
            method = a.threshold if a.threshold in ("otsu", "mean_sigma") else float(a.threshold)
            rect = detect.auto_crop(ser.read_ser(spark, a.input), a.samples, a.padding, bayer=head.colour in K.RED_AT, method=method, min_area=a.min_area)
            path = Path(a.input)
            target = a.output or str(path.with_name(f"{path.stem}_crop{rect[2]}x{rect[3]}{path.suffix}"))
            ser.crop_ser(spark, a.input, target, rect)
            print(f"{target}: {rect[2]}x{rect[3]} at {rect[0]},{rect[1]}")
    except (StackfieldError, ValueError, OSError) as e:
        print(f"stackfield: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
