"""PNG (8 bits) and TIFF (16 bits) images, grey or RGB, read and written."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np

from ..errors import InvalidSource
from ..functions.kernels import quantised

_PNG = b"\x89PNG\r\n\x1a\n"


def _samples(planes: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """(height, width, planes) of whole numbers."""
    return np.stack([quantised(p, most) for p in planes], -1)


def png_bytes(*planes: np.ndarray) -> bytes:
    a = _samples(planes, 255)
    h, w, n = a.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * n)], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def tiff_bytes(*planes: np.ndarray) -> bytes:
    a = _samples(planes, 65535).astype("<u2")
    h, w, n = a.shape
    data = a.tobytes()
    bits_at = 8 + len(data)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, n, 16 if n == 1 else bits_at), (259, 3, 1, 1), (262, 3, 1, 1 if n == 1 else 2), (273, 4, 1, 8), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(data)), (284, 3, 1, 1)]
    bits = struct.pack("<3H", 16, 16, 16) + b"\0\0" if n == 3 else b""
    return struct.pack("<2sHI", b"II", 42, bits_at + len(bits)) + data + bits + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)


def read_png(raw: bytes) -> np.ndarray:
    """(height, width, planes) in [0, 1]; 8 or 16 bits, grey or RGB, with or without alpha (left out)."""
    if not raw.startswith(_PNG):
        raise InvalidSource("not a PNG")
    at, data, head = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour not in (0, 2, 4, 6) or interlaced:
        raise InvalidSource("a PNG of this kind is not read")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = n * depth // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * step)
    out, above = np.zeros((h, w * step), np.uint8), np.zeros(w * step, np.int64)
    for y in range(h):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if how == 2:
            line = (line + above) & 255
        elif how == 1:
            line = (line.reshape(-1, step).cumsum(0) & 255).ravel()
        elif how in (3, 4):
            for i in range(len(line)):
                a = line[i - step] if i >= step else 0
                b, c = above[i], above[i - step] if i >= step else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (line[i] + guess) & 255
        out[y] = above = line
    values = out.view(">u2") if depth == 16 else out
    return (values.reshape(h, w, n)[..., : 3 if n > 2 else 1] / float(2**depth - 1)).astype(np.float32)


def read_tiff(raw: bytes) -> np.ndarray:
    """(height, width, planes) in [0, 1]; uncompressed strips of 8 or 16 bits."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise InvalidSource("not a TIFF")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        size, code = {3: (2, "H"), 4: (4, "I")}.get(kind, (1, "B"))
        place = at + 10 + 12 * k if size * n <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(f"{order}{n}{code}", raw, place) if kind in (3, 4) else ()
    w, h, depth, n = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(277, (1,))[0]
    if tags.get(259, (1,))[0] != 1 or depth not in (8, 16) or tags.get(284, (1,))[0] != 1:
        raise InvalidSource("a TIFF of this kind is not read")
    data = b"".join(raw[a : a + m] for a, m in zip(tags[273], tags[279], strict=True))
    a = np.frombuffer(data, order + "u2" if depth == 16 else np.uint8)[: h * w * n].reshape(h, w, n)
    return (a[..., : 3 if n > 2 else 1] / float(2**depth - 1)).astype(np.float32)


def save(path: str, *planes: np.ndarray) -> None:
    """PNG by the name's ending, else TIFF; one plane or three."""
    Path(path).write_bytes(png_bytes(*planes) if path.endswith(".png") else tiff_bytes(*planes))


def load(path: str) -> np.ndarray:
    raw = Path(path).read_bytes()
    return read_png(raw) if raw.startswith(_PNG) else read_tiff(raw)


def is_colour(path: str) -> bool:
    return load(path).shape[2] == 3


def display(a: np.ndarray, most: int = 8192) -> np.ndarray:
    """Eight bits, smaller if a side is longer than most."""
    from ..functions.kernels import resized

    side = max(a.shape)
    if side > most:
        a = resized(a, max(1, a.shape[0] * most // side), max(1, a.shape[1] * most // side))
    return quantised(a, 255)
