"""DuckDB SQL for the queries over captures, from the same tables.

px has the pixels of the frames (frame_index, label, r, c, v), pu those held
within 0 and 1. Everything is written down from the definitions, without regard
to how the operators compute it.
"""

from __future__ import annotations

from .queries import DIGITS

_PX = "px AS (SELECT vec_id AS frame_index, label, (i // 8)::INT AS r, (i % 8)::INT AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"
_PU = "pu AS (SELECT frame_index, label, r, c, least(greatest(v + 0.5, 0), 1)::FLOAT::DOUBLE AS v FROM px)"


def _r(x: str, name: str = "v") -> str:
    return f"round({x}, {DIGITS}) + 0.0 AS {name}"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((_PX, _PU, *ctes)) + "\n"


# The whole frame of a row as a list, so that neighbours are list elements.
def _list(table: str, name: str) -> str:
    return f"{name} AS (SELECT frame_index, label, list(v ORDER BY r, c) AS p FROM {table} GROUP BY frame_index, label)"


_RC = "SELECT a.frame_index, a.label, (i // 8)::INT AS r, (i % 8)::INT AS c, a.p FROM {0} a, range(64) t(i)"


def _at(r: str, c: str) -> str:
    return f"p[8 * ({r}) + ({c}) + 1]"


def _clamp(r: str, c: str) -> str:
    return _at(f"least(greatest({r}, 0), 7)", f"least(greatest({c}, 0), 7)")


_LF, _LU = _list("px", "lf"), _list("pu", "lu")
_FC, _UC = f"fc AS ({_RC.format('lf')})", f"uc AS ({_RC.format('lu')})"
_INSIDE = "r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6"

_LAP = f"lap AS (SELECT frame_index, label, {_at('r-1', 'c')} + {_at('r+1', 'c')} + {_at('r', 'c-1')} + {_at('r', 'c+1')} - 4 * {_at('r', 'c')} AS l FROM fc WHERE {_INSIDE})"
_GX = f"({_at('r-1', 'c+1')} - {_at('r-1', 'c-1')} + 2 * {_at('r', 'c+1')} - 2 * {_at('r', 'c-1')} + {_at('r+1', 'c+1')} - {_at('r+1', 'c-1')})"
_GY = f"({_at('r+1', 'c-1')} - {_at('r-1', 'c-1')} + 2 * {_at('r+1', 'c')} - 2 * {_at('r-1', 'c')} + {_at('r+1', 'c+1')} - {_at('r-1', 'c+1')})"


def _sobel(source: str, name: str) -> str:
    return f"{name} AS (SELECT frame_index, label, r, c, CASE WHEN {_INSIDE} THEN sqrt({_GX} * {_GX} + {_GY} * {_GY}) ELSE 0.0 END AS v FROM {source})"


_SCORE = "sc AS (SELECT frame_index, label, round(avg(l * l) - avg(l) * avg(l), 9) AS score FROM lap GROUP BY ALL)"
_GSCORE = f"sc AS (SELECT frame_index, label, round(avg(v), 9) AS score FROM sb WHERE {_INSIDE} GROUP BY ALL)"
_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, frame_index) AS rank, count(*) OVER (PARTITION BY label) AS n FROM sc)"
_KEEP = "greatest(1, least(n, ceil(n::FLOAT * 0.25::FLOAT)))"
_LAPSC = (_LF, _FC, _LAP, _SCORE)
_SOBSC = (_LF, _FC, _sobel("fc", "sb"), _GSCORE)


def _stacked(table: str, value: str, where: str = "") -> str:
    return f"SELECT label, r, c, {_r(value)} FROM {table} {where} GROUP BY label, r, c"


def _clip(source: str, name: str) -> str:
    """One round: what lies beyond 2.5 population deviations of those still in goes out."""
    return f"{name} AS (SELECT frame_index, label, r, c, v, ok AND (coalesce(d, 0) < 1e-10 OR abs(v - m) <= 2.5 * d) AS ok FROM (SELECT *, avg(v) FILTER (ok) OVER w AS m, stddev_pop(v) FILTER (ok) OVER w AS d FROM {source} WINDOW w AS (PARTITION BY label, r, c)))"


_PIX = "frame_index, r, c"

#: Rows of 8 values and a 0, so that they are 3 pixels of 3 values.
_NINE = "nine AS (SELECT frame_index, r, c, v FROM px UNION ALL SELECT DISTINCT frame_index, r, 8, 0.0 FROM px)"


def _point(expr: str, table: str = "pu") -> str:
    return _with() + f"SELECT {_PIX}, {_r(f'({expr})::FLOAT::DOUBLE')} FROM {table}"


def _unit(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def _taps(kernel: str, name: str, at: str) -> str:
    """Of each place o of an axis: the places c that its taps d lie at, with their weights w."""
    return f"t_{name} AS MATERIALIZED (SELECT o::INT AS o, ({at})::INT AS c, w FROM ({kernel}), (SELECT unnest(range(8)) AS o))"


def _separable(source: str, name: str) -> tuple[str, str]:
    """Rows first, then columns; each step is made once, whatever reads it."""
    rows = f"x_{name} AS MATERIALIZED (SELECT s.frame_index, s.label, s.r, t.o AS c, sum(t.w * s.v) AS v FROM {source} s JOIN t_{name} t ON s.c = t.c GROUP BY ALL)"
    cols = f"{name} AS MATERIALIZED (SELECT s.frame_index, s.label, t.o AS r, s.c, sum(t.w * s.v) AS v FROM x_{name} s JOIN t_{name} t ON s.r = t.c GROUP BY ALL)"
    return rows, cols


def _blur(source: str, name: str, sigma: float) -> tuple[str, ...]:
    """Taps of the separable kernel, rows first, edges repeated."""
    half = -(-int(3 * sigma * 1000) // 1000)
    kernel = f"SELECT d, exp(-d * d / (2.0 * {sigma} * {sigma})) / sum(exp(-d * d / (2.0 * {sigma} * {sigma}))) OVER () AS w FROM (SELECT unnest(range(-{half}, {half + 1})) AS d)"
    return _taps(kernel, name, "least(greatest(o + d, 0), 7)"), *_separable(source, name)


def _atrous(source: str, name: str, scale: int) -> tuple[str, ...]:
    """Five taps, 2^scale apart; the border mirrors with -1 at 1 and 8 at 7."""
    step = 2**scale
    kernel = f"SELECT * FROM (VALUES ({-2 * step}, 0.0625), ({-step}, 0.25), (0, 0.375), ({step}, 0.25), ({2 * step}, 0.0625)) k(d, w)"
    return _taps(kernel, name, "CASE WHEN abs(o + d) % 16 < 8 THEN abs(o + d) % 16 ELSE 15 - abs(o + d) % 16 END"), *_separable(source, name)


def _bayer(red: tuple[int, int], cross: str, diagonal: str, across: str, along: str) -> tuple[str, str, str]:
    row, col, own = f"(r % 2 = {red[0]})", f"(c % 2 = {red[1]})", _at("r", "c")
    red_v = f"CASE WHEN {row} AND {col} THEN {own} WHEN {row} THEN {across} WHEN {col} THEN {along} ELSE {diagonal} END"
    green = f"CASE WHEN {row} = {col} THEN {cross} ELSE {own} END"
    blue = f"CASE WHEN {row} AND {col} THEN {diagonal} WHEN {row} THEN {along} WHEN {col} THEN {across} ELSE {own} END"
    return red_v, green, blue


_CROSS = f"(({_clamp('r-1', 'c')} + {_clamp('r+1', 'c')} + {_clamp('r', 'c-1')} + {_clamp('r', 'c+1')}) / 4)"
_DIAGONAL = f"(({_clamp('r-1', 'c-1')} + {_clamp('r-1', 'c+1')} + {_clamp('r+1', 'c-1')} + {_clamp('r+1', 'c+1')}) / 4)"
_BILINEAR = _bayer((0, 0), _CROSS, _DIAGONAL, f"(({_clamp('r', 'c-1')} + {_clamp('r', 'c+1')}) / 2)", f"(({_clamp('r-1', 'c')} + {_clamp('r+1', 'c')}) / 2)")


def _kernel(taps: dict[tuple[int, int], int]) -> str:
    total = " + ".join(f"{w} * {_clamp(f'r+({i})', f'c+({j})')}" for (i, j), w in taps.items())
    return _unit(f"(({total}) / 16.0)")


_OWN, _AXIS = {(0, 0): 1}, [(-1, 0), (1, 0), (0, -1), (0, 1)]
_FAR = [(-2, 0), (2, 0), (0, -2), (0, 2)]
_CORNER = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
_MHC = _bayer(
    (0, 1),
    _kernel({(0, 0): 8, **dict.fromkeys(_AXIS, 4), **dict.fromkeys(_FAR, -2)}),
    _kernel({(0, 0): 12, **dict.fromkeys(_CORNER, 4), **dict.fromkeys(_FAR, -3)}),
    _kernel({(0, 0): 10, **dict.fromkeys([(0, -1), (0, 1)], 8), **dict.fromkeys(_CORNER, -2), **dict.fromkeys([(0, -2), (0, 2)], -2), **dict.fromkeys([(-2, 0), (2, 0)], 1)}),
    _kernel({(0, 0): 10, **dict.fromkeys([(-1, 0), (1, 0)], 8), **dict.fromkeys(_CORNER, -2), **dict.fromkeys([(-2, 0), (2, 0)], -2), **dict.fromkeys([(0, -2), (0, 2)], 1)}),
)


def _colours(planes: tuple[str, str, str]) -> str:
    return _with(_LU, _UC) + " UNION ALL ".join(f"SELECT {_PIX}, {_r(f'({x})::FLOAT::DOUBLE')}, '{n}' AS colour FROM uc" for n, x in zip("rgb", planes, strict=True))


# --- Fourier transforms as sums ----------------------------------------------

_FREQ = "fq AS (SELECT (i // 8)::INT AS u, (i % 8)::INT AS w FROM range(64) t(i))"


def _dft(source: str, name: str, value: str = "v") -> str:
    """re and im of each frequency, and the capture."""
    phase = "2 * pi() * (f.u * s.r + f.w * s.c) / 8"
    return f"{name} AS (SELECT s.frame_index, s.label, f.u, f.w, sum({value} * cos({phase})) AS re, -sum({value} * sin({phase})) AS im FROM {source} s, fq f GROUP BY ALL)"


_HANN = "(0.5 * (1 - cos(2 * pi() * s.r / 8))) * (0.5 * (1 - cos(2 * pi() * s.c / 8)))"
_PEAK = (
    "fi AS (SELECT label, min(frame_index) AS first FROM px GROUP BY label)",
    "cp AS (SELECT t.frame_index, t.u, t.w, a.re * t.re + a.im * t.im AS re, a.im * t.re - a.re * t.im AS im FROM ff t JOIN fi USING (label) JOIN ff a ON a.frame_index = fi.first AND a.u = t.u AND a.w = t.w)",
    "cn AS (SELECT frame_index, u, w, CASE WHEN sqrt(re * re + im * im) > 1e-12 THEN re / sqrt(re * re + im * im) ELSE 0 END AS re, CASE WHEN sqrt(re * re + im * im) > 1e-12 THEN im / sqrt(re * re + im * im) ELSE 0 END AS im FROM cp)",
    "co AS (SELECT n.frame_index, f.u AS r, f.w AS c, sum(n.re * cos(2 * pi() * (n.u * f.u + n.w * f.w) / 8) - n.im * sin(2 * pi() * (n.u * f.u + n.w * f.w) / 8)) / 64 AS v FROM cn n, fq f GROUP BY ALL)",
    "cl AS (SELECT frame_index, list(v ORDER BY r, c) AS p, avg(abs(v)) AS mean FROM co GROUP BY frame_index)",
    "pk AS (SELECT frame_index, p, mean, (list_position(list_transform(p, lambda x: round(x, 12)), round(list_max(p), 12)) - 1) AS k FROM cl)",
    "ps AS (SELECT *, (k // 8)::INT AS r, (k % 8)::INT AS c FROM pk)",
)


def _vertex(a: str, b: str, c: str) -> str:
    return f"CASE WHEN abs({a} - 2 * {b} + {c}) > 1e-12 THEN least(greatest(({a} - {c}) / (2 * ({a} - 2 * {b} + {c})), -0.5), 0.5) ELSE 0.0 END"


_SUB_Y = f"CASE WHEN {_INSIDE} THEN {_vertex(_at('r-1', 'c'), _at('r', 'c'), _at('r+1', 'c'))} ELSE 0.0 END"
_SUB_X = f"CASE WHEN {_INSIDE} THEN {_vertex(_at('r', 'c-1'), _at('r', 'c'), _at('r', 'c+1'))} ELSE 0.0 END"
_DY, _DX = f"CASE WHEN r > 4 THEN r - 8 ELSE r END + {_SUB_Y}", f"CASE WHEN c > 4 THEN c - 8 ELSE c END + {_SUB_X}"

_PSF = "pf AS (SELECT r, c, exp(-(y * y + x * x) / 2.0) / sum(exp(-(y * y + x * x) / 2.0)) OVER () AS v, 0 AS frame_index, 0 AS label FROM (SELECT (i // 8)::INT AS r, (i % 8)::INT AS c, CASE WHEN i // 8 <= 4 THEN i // 8 ELSE i // 8 - 8 END AS y, CASE WHEN i % 8 <= 4 THEN i % 8 ELSE i % 8 - 8 END AS x FROM range(64) t(i)))"


def _bilinear(y: str, x: str) -> str:
    """A sample of p at (y, x), 0 outside."""
    at = lambda r, c: f"(CASE WHEN {r} BETWEEN 0 AND 7 AND {c} BETWEEN 0 AND 7 THEN p[(8 * {r} + {c} + 1)::INT] ELSE 0.0 END)"
    y0, x0 = f"floor({y})", f"floor({x})"
    fy, fx = f"({y} - {y0})", f"({x} - {x0})"
    return f"({at(y0, x0)} * (1 - {fy}) * (1 - {fx}) + {at(y0, f'({x0} + 1)')} * (1 - {fy}) * {fx} + {at(f'({y0} + 1)', x0)} * {fy} * (1 - {fx}) + {at(f'({y0} + 1)', f'({x0} + 1)')} * {fy} * {fx})"


_APS = "ap AS (SELECT a.frame_index, a.label, y AS cy, x AS cx, (SELECT avg(n.v) FROM pu n WHERE n.frame_index = a.frame_index AND n.r BETWEEN y - 2 AND y + 1 AND n.c BETWEEN x - 2 AND x + 1) AS m FROM (SELECT DISTINCT frame_index, label FROM px) a, (VALUES (2), (4), (6)) yy(y), (VALUES (2), (4), (6)) xx(x)), ag AS (SELECT * FROM ap WHERE m >= 0.5)"

ORACLES = {
    "laplacian_score": _with(*_LAPSC) + f"SELECT frame_index, {_r('score', 'score')} FROM sc".replace(" + 0.0", ""),
    "gradient_score": _with(*_SOBSC) + f"SELECT frame_index, {_r('score', 'score')} FROM sc".replace(" + 0.0", ""),
    "rank_frames": _with(*_LAPSC, _RANKED) + "SELECT label, frame_index, rank FROM rk",
    "rank_gradient": _with(*_SOBSC, _RANKED) + "SELECT label, frame_index, rank FROM rk",
    "select_best_frames": _with(*_LAPSC, _RANKED) + f"SELECT label, frame_index, rank FROM rk WHERE rank <= {_KEEP}",
    "top_n_quality": _with(*_LAPSC) + f"SELECT frame_index, label, round(score, {DIGITS}) AS score FROM sc ORDER BY sc.score DESC, frame_index LIMIT 20",
    "quality_summary": _with(*_LAPSC) + f"SELECT label, count(*) AS n_frames, {_r('max(score)', 'best_score')}, {_r('min(score)', 'worst_score')} FROM sc GROUP BY label",
    "sample_frames": "SELECT vec_id AS frame_index, label FROM embeddings WHERE vec_id IN (SELECT i * (n - 1) // 29 FROM range(30) t(i), (SELECT count(*) AS n FROM embeddings))",
    "mean_stack": _with() + _stacked("px", "avg(v)"),
    "median_stack": _with() + _stacked("px", "median(v)"),
    "sigma_clip_stack": _with("c0 AS (SELECT *, true AS ok FROM px)", _clip("c0", "c1"), _clip("c1", "c2")) + f"SELECT label, r, c, {_r('coalesce(avg(v) FILTER (ok), avg(v))')} FROM c2 GROUP BY label, r, c",
    "weighted_mean_stack": _with(*_LAPSC) + f"SELECT label, r, c, {_r('CASE WHEN sum(greatest(score, 0)) >= 1e-15 THEN sum(v * greatest(score, 0)) / sum(greatest(score, 0)) ELSE avg(v) END')} FROM px JOIN sc USING (frame_index, label) GROUP BY label, r, c",
    "mean_of_selected": _with(*_LAPSC, _RANKED) + _stacked("px", "avg(v)", f"WHERE frame_index IN (SELECT frame_index FROM rk WHERE rank <= {_KEEP})"),
    "drizzle": _with("dr AS (SELECT label, v, (r - (frame_index % 3 - 1) / 3.0) * 2 AS y, (c - (frame_index % 5 - 2) / 4.0) * 2 AS x FROM pu WHERE abs(v) >= 1.1920928955078125e-07)", "gr AS (SELECT (i // 16)::INT AS r, (i % 16)::INT AS c FROM range(256) t(i))", "ov AS (SELECT label, g.r, g.c, v, greatest(least(y + 0.7, g.r + 1) - greatest(y - 0.7, g.r), 0) * greatest(least(x + 0.7, g.c + 1) - greatest(x - 0.7, g.c), 0) AS a FROM dr, gr g WHERE y + 0.7 > g.r AND y - 0.7 < g.r + 1 AND x + 0.7 > g.c AND x - 0.7 < g.c + 1)") + f"SELECT l.label, g.r, g.c, {_r(_unit('CASE WHEN coalesce(sum(a), 0) > 0 THEN sum(v * a) / sum(a) ELSE 0.0 END'))} FROM (SELECT DISTINCT label FROM px) l CROSS JOIN gr g LEFT JOIN ov o ON o.label = l.label AND o.r = g.r AND o.c = g.c GROUP BY l.label, g.r, g.c",
    "hist_stretch": _point(_unit("(v - 0.2::DOUBLE) / (0.8::DOUBLE - 0.2::DOUBLE)")),
    "gamma": _point(f"pow({_unit('v')}, 1 / 2.2::DOUBLE)"),
    "brightness_contrast": _point(_unit("(v - 0.5::DOUBLE) * 1.4::DOUBLE + 0.5::DOUBLE + 0.05::DOUBLE")),
    "filter_chain": _with() + f"SELECT {_PIX}, {_r(f'({_unit("(v - 0.5::DOUBLE) * 1.2::DOUBLE + 0.5::DOUBLE + 0.05::DOUBLE")})::FLOAT::DOUBLE')} FROM (SELECT {_PIX}, pow(v, 0.5)::FLOAT::DOUBLE AS v FROM (SELECT {_PIX}, ({_unit('(v - 0.2::DOUBLE) / (0.8::DOUBLE - 0.2::DOUBLE)')})::FLOAT::DOUBLE AS v FROM pu))",
    "auto_stretch": _with("so AS (SELECT frame_index, list_sort(list(v)) AS s FROM pu GROUP BY frame_index)", "bw AS (SELECT frame_index, s[1 + least(trunc(64::FLOAT * 0.05::FLOAT)::INT, 63)] AS b, s[1 + least(trunc(64::FLOAT * 0.95::FLOAT)::INT, 63)] AS w FROM so)") + f"SELECT {_PIX}, {_r('(' + _unit('(v - b) / (CASE WHEN abs(w - b) < 1e-10 THEN 1.0 ELSE w - b END)') + ')::FLOAT::DOUBLE')} FROM pu JOIN bw USING (frame_index)",
    "gaussian_blur": _with(*_blur("pu", "bl", 1.0)) + f"SELECT {_PIX}, {_r('v::FLOAT::DOUBLE')} FROM bl",
    "unsharp_mask": _with(*_blur("pu", "bl", 1.0)) + f"SELECT p.frame_index, p.r, p.c, {_r('(CASE WHEN abs(p.v - b.v) > 0.02 THEN ' + _unit('p.v + (p.v - b.v) * 0.8::DOUBLE') + ' ELSE p.v END)::FLOAT::DOUBLE')} FROM pu p JOIN bl b USING (frame_index, r, c)",
    "sobel": _with(_LF, _FC, _sobel("fc", "sb")) + f"SELECT {_PIX}, {_r('v::FLOAT::DOUBLE')} FROM sb",
    "quantize16": _with() + f"SELECT {_PIX}, floor(v::FLOAT * 65535::FLOAT)::DOUBLE AS v FROM pu",
    "quantize8": _with() + f"SELECT {_PIX}, floor(v::FLOAT * 255::FLOAT)::DOUBLE AS v FROM pu",
    "crop_frames": _with() + f"SELECT frame_index, r - 1 AS r, c - 2 AS c, {_r('v')} FROM px WHERE r BETWEEN 1 AND 6 AND c BETWEEN 2 AND 6",
    "debayer_bilinear": _colours(_BILINEAR),
    "debayer_mhc": _colours(_MHC),
    "luminance": _with(_LU, _UC) + f"SELECT {_PIX}, {_r('(0.299::DOUBLE * (' + _BILINEAR[0] + ')::FLOAT::DOUBLE + 0.587::DOUBLE * (' + _BILINEAR[1] + ')::FLOAT::DOUBLE + 0.114::DOUBLE * (' + _BILINEAR[2] + ')::FLOAT::DOUBLE)::FLOAT::DOUBLE')} FROM uc",
    "split_rgb": _with(_NINE) + f"SELECT frame_index, r, (c // 3)::INT AS c, {_r('v')}, substr('rgb', (c % 3 + 1)::INT, 1) AS colour FROM nine",
    "merge_rgb": _with(_NINE) + f"SELECT frame_index, r, (c // 3 * 3 + 2 - c % 3)::INT AS c, {_r('v')} FROM nine",
    "phase_correlation": _with(_FREQ, _dft("pu", "ff", f"s.v * {_HANN}"), *_PEAK) + f"SELECT frame_index, {_r(_DY, 'dy')}, {_r(_DX, 'dx')}, {_r('CASE WHEN mean > 1e-15 THEN ' + _at('r', 'c') + ' / mean ELSE 0.0 END', 'confidence')} FROM ps",
    "gradient_correlation": _with(_FREQ, _LU, _UC, _sobel("uc", "sb"), _dft("sb", "ff", f"s.v * {_HANN}"), *_PEAK) + f"SELECT frame_index, {_r(_DY, 'dy')}, {_r(_DX, 'dx')} FROM ps",
    "centroid_offset": _with("mx AS (SELECT frame_index, label, max(v) AS m FROM pu GROUP BY ALL)", "ce AS (SELECT frame_index, label, CASE WHEN any_value(m) > 0 THEN sum(r * v) FILTER (v > 0.5 * m) / sum(v) FILTER (v > 0.5 * m) ELSE 4.0 END AS y, CASE WHEN any_value(m) > 0 THEN sum(c * v) FILTER (v > 0.5 * m) / sum(v) FILTER (v > 0.5 * m) ELSE 4.0 END AS x FROM pu JOIN mx USING (frame_index, label) GROUP BY ALL)", "fi AS (SELECT label, min(frame_index) AS first FROM px GROUP BY label)") + f"SELECT t.frame_index, {_r('t.y - a.y', 'dy')}, {_r('t.x - a.x', 'dx')} FROM ce t JOIN fi USING (label) JOIN ce a ON a.frame_index = fi.first",
    "shift_frames": _with(_LF, _FC) + f"SELECT {_PIX}, {_r('(' + _bilinear('(r - (frame_index % 3 - 1) / 4.0::DOUBLE)', '(c - (frame_index % 5 - 2) / 2.0::DOUBLE)') + ')::FLOAT::DOUBLE')} FROM fc",
    "pyramid_level": _with(*_blur("pu", "bl", 1.0)) + f"SELECT frame_index, (r // 2)::INT AS r, (c // 2)::INT AS c, {_r('v::FLOAT::DOUBLE')} FROM bl WHERE r % 2 = 0 AND c % 2 = 0",
    "fft2d": _with(_FREQ, _dft("px", "ff")) + f"SELECT frame_index, u, w, {_r('re', 're')}, {_r('im', 'im')} FROM ff",
    "hann_window": _with() + f"SELECT {_PIX}, {_r(f'(s.v * {_HANN})::FLOAT::DOUBLE')} FROM px s",
    "wavelet_decompose": _with(*_atrous("pu", "w0", 0), *_atrous("w0", "w1", 1)) + f"SELECT frame_index, 0 AS layer, r, c, {_r('(a.v - b.v)::FLOAT::DOUBLE')} FROM pu a JOIN w0 b USING (frame_index, r, c) UNION ALL SELECT frame_index, 1, r, c, {_r('(a.v - b.v)::FLOAT::DOUBLE')} FROM w0 a JOIN w1 b USING (frame_index, r, c) UNION ALL SELECT frame_index, 2, r, c, {_r('v::FLOAT::DOUBLE')} FROM w1",
    "wavelet_sharpen": _with(*_atrous("pu", "w0", 0), *_atrous("w0", "w1", 1)) + f"SELECT frame_index, r, c, {_r('(' + _unit('w1.v + 1.5 * sign(pu.v - w0.v) * greatest(abs(pu.v - w0.v) - 0.02, 0) + 1.3 * (w0.v - w1.v)') + ')::FLOAT::DOUBLE')} FROM pu JOIN w0 USING (frame_index, r, c) JOIN w1 USING (frame_index, r, c)",
    "wiener": _with(_FREQ, _PSF, _dft("pu", "ff"), _dft("pf", "hh"), "qq AS (SELECT f.frame_index, f.u, f.w, (f.re * h.re + f.im * h.im) / (h.re * h.re + h.im * h.im + 0.01::DOUBLE) AS re, (f.im * h.re - f.re * h.im) / (h.re * h.re + h.im * h.im + 0.01::DOUBLE) AS im FROM ff f JOIN hh h USING (u, w))", "iv AS (SELECT n.frame_index, f.u AS r, f.w AS c, sum(n.re * cos(2 * pi() * (n.u * f.u + n.w * f.w) / 8) - n.im * sin(2 * pi() * (n.u * f.u + n.w * f.w) / 8)) / 64 AS v FROM qq n, fq f GROUP BY ALL)") + f"SELECT {_PIX}, {_r('(' + _unit('v') + ')::FLOAT::DOUBLE')} FROM iv",
    "threshold_mean_sigma": _with() + f"SELECT frame_index, {_r('avg(v) + 2 * stddev_pop(v)', 'threshold')} FROM px GROUP BY frame_index",
    "otsu_threshold": _with("hi AS (SELECT frame_index, trunc(v::FLOAT * 255::FLOAT)::INT AS b, count(*)::DOUBLE AS n FROM pu GROUP BY ALL)", "cu AS (SELECT frame_index, b, sum(n) OVER w AS wb, sum(b * n) OVER w AS sb, sum(n) OVER (PARTITION BY frame_index) AS t, sum(b * n) OVER (PARTITION BY frame_index) AS s FROM hi WINDOW w AS (PARTITION BY frame_index ORDER BY b))", "va AS (SELECT frame_index, b, CASE WHEN t > wb THEN wb * (t - wb) * (sb / wb - (s - sb) / (t - wb)) ** 2 ELSE 0 END AS v FROM cu)", "bb AS (SELECT frame_index, CASE WHEN max(v) > 0 THEN min_by(b, struct_pack(a := -v, b := b)) ELSE 0 END AS b FROM va GROUP BY frame_index)") + f"SELECT frame_index, {_r('(b + 0.5::DOUBLE) / 256', 'threshold')} FROM bb",
    "morph_opening": _with("er AS (SELECT t.frame_index, t.r, t.c, count(*) FILTER (n.v > -0.1::DOUBLE) = 9 AS ok FROM px t JOIN px n ON n.frame_index = t.frame_index AND n.r BETWEEN t.r - 1 AND t.r + 1 AND n.c BETWEEN t.c - 1 AND t.c + 1 GROUP BY ALL)") + "SELECT t.frame_index, t.r, t.c, bool_or(n.ok)::INT AS v FROM er t JOIN er n ON n.frame_index = t.frame_index AND n.r BETWEEN t.r - 1 AND t.r + 1 AND n.c BETWEEN t.c - 1 AND t.c + 1 GROUP BY ALL",
    "connected_components": _with("mk AS (SELECT frame_index, r, c FROM px WHERE v > 0.05::DOUBLE)", "re(frame_index, r, c, root) AS (SELECT frame_index, r, c, 8 * r + c FROM mk UNION SELECT m.frame_index, m.r, m.c, x.root FROM re x JOIN mk m ON m.frame_index = x.frame_index AND abs(m.r - x.r) + abs(m.c - x.c) = 1 WHERE x.root < 8 * m.r + m.c)", "lb AS (SELECT frame_index, r, c, min(root) AS root FROM re GROUP BY ALL)", "cs AS (SELECT frame_index, root, count(*) AS area, min(r) AS min_row, max(r) AS max_row, min(c) AS min_col, max(c) AS max_col FROM lb GROUP BY ALL)") + "SELECT frame_index, row_number() OVER (PARTITION BY frame_index ORDER BY area DESC, root) AS place, area, min_row, max_row, min_col, max_col FROM cs",
    "frame_background": _with("so AS (SELECT frame_index, list_sort(list(v)) AS s FROM px GROUP BY frame_index)") + f"SELECT frame_index, {_r('s[33]', 'background')} FROM so",
    "masked_centroid": _with("so AS (SELECT frame_index, list_sort(list(v))[33] AS b FROM px GROUP BY frame_index)", "ms AS (SELECT frame_index, r, c, greatest(v - b, 0) AS w FROM px JOIN so USING (frame_index) WHERE v > 0)") + f"SELECT f.frame_index, {_r('CASE WHEN sum(w) > 0 THEN sum(r * w) / sum(w) ELSE (min(r) + max(r)) / 2.0 END', 'cy')}, {_r('CASE WHEN sum(w) > 0 THEN sum(c * w) / sum(w) ELSE (min(c) + max(c)) / 2.0 END', 'cx')} FROM (SELECT DISTINCT frame_index FROM px) f LEFT JOIN ms USING (frame_index) GROUP BY f.frame_index",
    "ap_grid": _with(_APS) + "SELECT frame_index, (row_number() OVER (PARTITION BY frame_index ORDER BY cy, cx) - 1)::INT AS ap_index, cy, cx FROM ag",
    "ap_blend": _with(_APS, "bw AS (SELECT t.frame_index, t.r, t.c, any_value(t.v) AS v, coalesce(sum(0.25 * (1 - cos(2 * pi() * (t.r - cy + 2) / 4)) * (1 - cos(2 * pi() * (t.c - cx + 2) / 4))), 0) AS w FROM pu t LEFT JOIN ag ON ag.frame_index = t.frame_index AND t.r BETWEEN cy - 2 AND cy + 1 AND t.c BETWEEN cx - 2 AND cx + 1 GROUP BY ALL)").replace("GROUP BY ALL)", "GROUP BY t.frame_index, t.r, t.c)") + f"SELECT {_PIX}, {_r('CASE WHEN w > 1e-12 THEN v ELSE 0.0 END')} FROM bw",
}


def _clipped(axis: str) -> str:
    """Three rounds of clipping at 2.5 deviations along one axis, sharing one mask; below three values nothing goes."""
    out = []
    for k in range(3):
        source = f"{axis}{k}"
        out.append(f"{axis}{k + 1} AS (SELECT label, frame_index, cx, cy, ok AND (n < 3 OR coalesce(d, 0) < 1e-10 OR abs({axis} - m) <= 2.5 * d) AS ok FROM (SELECT *, count(*) FILTER (ok) OVER w AS n, avg({axis}) FILTER (ok) OVER w AS m, stddev_pop({axis}) FILTER (ok) OVER w AS d FROM {source} WINDOW w AS (PARTITION BY label)))")
    return ",\n".join(out)


_CENTRES = "mx AS (SELECT frame_index, label, max(v) AS m FROM pu GROUP BY ALL), ce AS (SELECT frame_index, label, CASE WHEN any_value(m) > 0 THEN sum(r * v) FILTER (v > 0.6 * m) / sum(v) FILTER (v > 0.6 * m) ELSE 4.0 END AS cy, CASE WHEN any_value(m) > 0 THEN sum(c * v) FILTER (v > 0.6 * m) / sum(v) FILTER (v > 0.6 * m) ELSE 4.0 END AS cx FROM pu JOIN mx USING (frame_index, label) GROUP BY ALL)"
ORACLES["temporal_analysis"] = _with(_CENTRES, "cx0 AS (SELECT label, frame_index, cx, cy, true AS ok FROM ce)", _clipped("cx"), "cy0 AS (SELECT * FROM cx3)", _clipped("cy"), "fl AS (SELECT label, cx, cy, ok OR count(*) FILTER (ok) OVER (PARTITION BY label) < 2 AS ok FROM cy3)") + f"SELECT label, {_r('median(cx)', 'median_cx')}, {_r('median(cy)', 'median_cy')}, {_r('max(cx) - min(cx)', 'drift_range_x')}, {_r('max(cy) - min(cy)', 'drift_range_y')}, count(*) AS valid_count FROM fl WHERE ok GROUP BY label"
