"""The parameters of a run, and TOML for them."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Config:
    """stack: mean, median, sigma_clip, multi_point, drizzle or surface_warp.
    align: phase, enhanced, centroid, gradient or pyramid. sign: compat keeps
    every method's own sign, corrected makes all of them agree. device and
    memory are accepted; Spark decides where work runs and what it holds."""

    input: str = ""
    output: str = ""
    device: str = "auto"
    memory: str = "auto"
    debayer: str = "auto"
    force_mono: bool = False
    select: float = 0.25
    metric: str = "laplacian"
    align: str = "phase"
    upsample: int = 20
    centroid_threshold: float = 0.1
    pyramid_levels: int = 3
    sign: str = "compat"
    stack: str = "mean"
    sigma: float = 2.5
    iterations: int = 2
    ap_size: int = 64
    search_radius: int = 16
    min_brightness: float = 0.05
    local_stack: str = "mean"
    scale: float = 2.0
    pixfrac: float = 0.7
    quality_weighted: bool = True
    sharpen: bool = False
    layers: int = 6
    coefficients: list[float] = field(default_factory=lambda: [1.5, 1.3, 1.2, 1.1, 1.0, 1.0])
    denoise: list[float] = field(default_factory=list)
    deconvolution: str = ""
    psf: str = "gaussian"
    psf_value: float = 2.0
    rl_iterations: int = 20
    wiener_noise: float = 0.001
    filters: list[dict] = field(default_factory=list)

    def __post_init__(self):
        choices = {"metric": ("laplacian", "gradient"), "align": ("phase", "enhanced", "centroid", "gradient", "pyramid"), "stack": ("mean", "median", "sigma_clip", "multi_point", "drizzle", "surface_warp"), "sign": ("compat", "corrected"), "debayer": ("auto", "off", "bilinear", "mhc"), "local_stack": ("mean", "median", "sigma_clip"), "psf": ("gaussian", "kolmogorov", "airy"), "deconvolution": ("", "richardson_lucy", "wiener")}
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(map(repr, allowed))}, not {getattr(self, name)!r}")


def loads(text: str) -> Config:
    given = tomllib.loads(text)
    unknown = given.keys() - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return Config(**given)


def _value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{k} = {_value(x)}" for k, x in v.items()) + " }"
    return repr(v)


def dumps(config: Config) -> str:
    return "".join(f"{k} = {_value(v)}\n" for k, v in asdict(config).items())


def number_list(text: str, strict: bool = False) -> list[float]:
    """Numbers between commas; others are left out, or an error if strict."""
    out = []
    for part in text.split(","):
        try:
            out.append(float(part))
        except ValueError:
            if strict:
                raise ValueError(f"{part.strip()!r} is no number") from None
    return out
