"""Weights of coefficients: the eight ways in which a stream gives the tables of the seventeen kinds of block, and the format's defaults.

A table is an array [channel, row, column] in the layout of coefficients, rows the shorter side; a coefficient is worth its table's inverse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tessera.bitstream.bits import Bits, BitSink, StreamError
from tessera.operators.vardct import CORNER_FREQUENCY

LEAST = 1e-8

# Rows and columns in samples of the kinds in the order of the stream, and the default parameters of each.
SIZES = {
    "dct8x8": (8, 8), "identity": (8, 8), "dct2x2": (8, 8), "dct4x4": (8, 8), "dct16x16": (16, 16), "dct32x32": (32, 32), "dct8x16": (8, 16), "dct8x32": (8, 32), "dct16x32": (16, 32), "dct4x8": (8, 8),
    "corner": (8, 8), "dct64x64": (64, 64), "dct32x64": (32, 64), "dct128x128": (128, 128), "dct64x128": (64, 128), "dct256x256": (256, 256), "dct128x256": (128, 256),
}
BANDS = {
    "dct8x8": [[3150.0, 0.0, -0.4, -0.4, -0.4, -2.0], [560.0, 0.0, -0.3, -0.3, -0.3, -0.3], [512.0, -2.0, -1.0, 0.0, -1.0, -2.0]],
    "dct4x4": [[2200.0, 0.0, 0.0, 0.0], [392.0, 0.0, 0.0, 0.0], [112.0, -0.25, -0.25, -0.5]],
    "dct16x16": [
        [8996.8725711814115328, -1.3000777393353804, -0.49424529824571225, -0.439093774457103443, -0.6350101832695744, -0.90177264050827612, -1.6162099239887414],
        [3191.48366296844234752, -0.67424582104194355, -0.80745813428471001, -0.44925837484843441, -0.35865440981033403, -0.31322389111877305, -0.37615025315725483],
        [1157.50408145487200256, -2.0531423165804414, -1.4, -0.50687130033378396, -0.42708730624733904, -1.4856834539296244, -4.9209142884401604],
    ],
    "dct32x32": [
        [15718.40830982518931456, -1.025, -0.98, -0.9012, -0.4, -0.48819395464, -0.421064, -0.27],
        [7305.7636810695983104, -0.8041958212306401, -0.7633036457487539, -0.55660379990111464, -0.49785304658857626, -0.43699592683512467, -0.40180866526242109, -0.27321683125358037],
        [3803.53173721215041536, -3.060733579805728, -2.0413270132490346, -2.0235650159727417, -0.5495389509954993, -0.4, -0.4, -0.3],
    ],
    "dct8x16": [[7240.7734393502, -0.7, -0.7, -0.2, -0.2, -0.2, -0.5], [1448.15468787004, -0.5, -0.5, -0.5, -0.2, -0.2, -0.2], [506.854140754517, -1.4, -0.2, -0.5, -0.5, -1.5, -3.6]],
    "dct8x32": [
        [16283.2494710648897, -1.7812845336559429, -1.6309059012653515, -1.0382179034313539, -0.85, -0.7, -0.9, -1.2360638576849587],
        [5089.15750884921511936, -0.320049391452786891, -0.35362849922161446, -0.30340000000000003, -0.61, -0.5, -0.5, -0.6],
        [3397.77603275308720128, -0.321327362693153371, -0.34507619223117997, -0.70340000000000003, -0.9, -1.0, -1.0, -1.1754605576265209],
    ],
    "dct16x32": [
        [13844.97076442300573, -0.97113799999999995, -0.658, -0.42026, -0.22712, -0.2206, -0.226, -0.6],
        [4798.964084220744293, -0.61125308982767057, -0.83770786552491361, -0.79014862079498627, -0.2692727459704829, -0.38272769465388551, -0.22924222653091453, -0.20719098826199578],
        [1807.236946760964614, -1.2, -1.2, -0.7, -0.7, -0.7, -0.4, -0.5],
    ],
    "dct4x8": [
        [2198.050556016380522, -0.96269623020744692, -0.76194253026666783, -0.6551140670773547],
        [764.3655248643528689, -0.92630200888366945, -0.9675229603596517, -0.27845290869168118],
        [527.107573587542228, -1.4594385811273854, -1.450082094097871593, -1.5843722511996204],
    ],
}
IDENTITY = [[280.0, 3160.0, 3160.0], [60.0, 864.0, 864.0], [18.0, 200.0, 200.0]]
HAAR = [[3840.0, 2560.0, 1280.0, 640.0, 480.0, 300.0], [960.0, 640.0, 320.0, 180.0, 140.0, 120.0], [640.0, 320.0, 128.0, 64.0, 32.0, 16.0]]
CORNER = [[3072.0, 3072.0, 256.0, 256.0, 256.0, 414.0, 0.0, 0.0, 0.0], [1024.0, 1024.0, 50.0, 50.0, 50.0, 58.0, 0.0, 0.0, 0.0], [384.0, 384.0, 12.0, 12.0, 12.0, 22.0, -0.25, -0.25, -0.25]]
# Large kinds: a factor of each kind, the first band of squares and of oblongs, and steps that all of them share.
LARGE = {"dct64x64": 0.9, "dct32x64": 0.65, "dct128x128": 1.8, "dct64x128": 1.3, "dct256x256": 3.6, "dct128x256": 2.6}
SQUARE, OBLONG = (26629.073922049845, 9311.3238710010046, 4992.2486445538634), (23629.073922049845, 8611.3238710010046, 4492.2486445538634)
STEPS = [
    [-1.025, -0.78, -0.65012, -0.19041574084286472, -0.20819395464, -0.421064, -0.32733845535848671],
    [-0.3041958212306401, -0.3633036457487539, -0.35660379990111464, -0.3443074455424403, -0.33699592683512467, -0.30180866526242109, -0.27321683125358037],
    [-1.2, -1.2, -0.8, -0.7, -0.7, -0.4, -0.5],
]


@dataclass(frozen=True)
class Encoding:
    """How a kind's table is given; every field is an array whose first axis is the channel."""

    mode: str  # default, identity, haar, quarters, halves, corner, bands, raw
    values: np.ndarray | None = None  # weights, factors or entries, as the mode has them
    bands: np.ndarray | None = None
    more: np.ndarray | None = None  # corner: the bands of its 4x4 part
    unit: float = 1.0  # raw: what an entry counts


MODES = ("default", "identity", "haar", "quarters", "halves", "corner", "bands", "raw")


def default(kind: str) -> Encoding:
    a = lambda v: np.array(v, dtype=float)
    if kind in LARGE:
        rows, cols = SIZES[kind]
        first = SQUARE if rows == cols else OBLONG
        return Encoding("bands", bands=a([[LARGE[kind] * f, *s] for f, s in zip(first, STEPS)]))
    special = {
        "identity": lambda: Encoding("identity", a(IDENTITY)),
        "dct2x2": lambda: Encoding("haar", a(HAAR)),
        "dct4x4": lambda: Encoding("quarters", np.ones((3, 2)), a(BANDS[kind])),
        "dct4x8": lambda: Encoding("halves", np.ones((3, 1)), a(BANDS[kind])),
        "corner": lambda: Encoding("corner", a(CORNER), a(BANDS["dct4x8"]), a(BANDS["dct4x4"])),
    }
    return special[kind]() if kind in special else Encoding("bands", bands=a(BANDS[kind]))


def levels(bands: np.ndarray) -> np.ndarray:
    """A first weight and relative steps to weights: a step s multiplies by 1 + s, or divides by 1 - s where it is not positive."""
    steps = bands[:, 1:]
    out = np.cumprod(np.concatenate([bands[:, :1], np.where(steps > 0, 1 + steps, 1 / (1 + np.abs(steps)))], axis=1), axis=1)
    if (out < LEAST).any():
        raise StreamError("a band of weights vanishes")
    return out


def between(levels_: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Geometric interpolation between the levels at a place in 0 <= place < n - 1, for each channel."""
    i = place.astype(int)
    low, high = levels_[:, i], levels_[:, i + 1]
    return low * (high / low) ** (place - i)


def by_distance(bands: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Weights that follow the distance from the corner; the far corner is the last level."""
    w = levels(bands)
    if w.shape[1] == 1:
        return np.broadcast_to(w[:, :, None], (len(w), rows, cols)).copy()
    y, x = np.mgrid[0:rows, 0:cols] / (np.array([rows, cols]) - 1).reshape(2, 1, 1)
    return between(w, np.hypot(y, x) * (w.shape[1] - 1) / (np.sqrt(2) + 1e-6))


def weights(encoding: Encoding, kind: str) -> np.ndarray:
    """[channel, row, column] of a kind's encoding; weights beyond what the format allows are an error."""
    e = default(kind) if encoding.mode == "default" else encoding
    rows, cols = SIZES[kind]
    out = np.ones((3, rows, cols))
    if e.mode == "identity":
        out *= e.values[:, :1, None]
        out[:, 0, 1] = out[:, 1, 0] = e.values[:, 1]
        out[:, 1, 1] = e.values[:, 2]
    elif e.mode == "haar":
        for k, n in enumerate((1, 2, 4)):
            out[:, :n, n : 2 * n] = out[:, n : 2 * n, :n] = e.values[:, 2 * k, None, None]
            out[:, n : 2 * n, n : 2 * n] = e.values[:, 2 * k + 1, None, None]
        out[:, 0, 0] = 1  # never used
    elif e.mode == "quarters":
        out = by_distance(e.bands, 4, 4).repeat(2, axis=1).repeat(2, axis=2)
        out[:, 0, 1] /= e.values[:, 0]
        out[:, 1, 0] /= e.values[:, 0]
        out[:, 1, 1] /= e.values[:, 1]
    elif e.mode == "halves":
        out = by_distance(e.bands, 4, 8).repeat(2, axis=1)
        out[:, 1, 0] /= e.values[:, 0]
    elif e.mode == "corner":
        lowest, highest = CORNER_FREQUENCY[CORNER_FREQUENCY > 0].min(), CORNER_FREQUENCY.max()
        place = (np.maximum(CORNER_FREQUENCY, lowest) - lowest) * 3 / (highest - lowest + 1e-6)
        out[:, ::2, ::2] = between(levels(e.values[:, 5:]), place)
        out[:, 1::2] = by_distance(e.bands, 4, 8)
        out[:, ::2, 1::2] = by_distance(e.more, 4, 4)
        out[:, 0, 0] = 1
        for k, (y, x) in enumerate(((1, 0), (0, 1), (2, 0), (0, 2), (2, 2))):
            out[:, y, x] = e.values[:, k]
    elif e.mode == "bands":
        out = by_distance(e.bands, rows, cols)
    else:
        out = 1 / (e.unit * e.values.reshape(3, rows, cols))
    if not ((out >= LEAST) & (out <= 1 / LEAST)).all():
        raise StreamError("a weight is out of range")
    return out


# streams

_COUNTS = {"identity": 3, "haar": 6, "quarters": 2, "halves": 1, "corner": 9}
_SCALED = {"identity": 3, "haar": 6, "corner": 6}  # so many values a channel are stored in units of 64


def _read_bands(b: Bits) -> np.ndarray:
    n = b.read(4) + 1
    out = np.array([[b.f16() for _ in range(n)] for _ in range(3)])
    if (out[:, 0] < LEAST).any():
        raise StreamError("a first band is too small")
    out[:, 0] *= 64
    return out


def read_encoding(b: Bits, kind: str, raw: Callable[[Bits, str], np.ndarray] | None = None) -> Encoding:
    """raw reads the three channels of integers of a raw table, a modular sub-stream."""
    mode = MODES[b.read(3)]
    if mode in _COUNTS:
        if SIZES[kind] != (8, 8):
            raise StreamError(f"{mode} weights of a large block")
        values = np.array([[b.f16() for _ in range(_COUNTS[mode])] for _ in range(3)])
        if mode != "corner" and (abs(values) < LEAST).any():
            raise StreamError("a weight is too small")
        values[:, : _SCALED.get(mode, 0)] *= 64
        bands = _read_bands(b) if mode in ("quarters", "halves", "corner") else None
        return Encoding(mode, values, bands, _read_bands(b) if mode == "corner" else None)
    if mode == "bands":
        return Encoding(mode, bands=_read_bands(b))
    if mode == "raw":
        unit = b.f16()
        if unit < LEAST:
            raise StreamError("the unit of a raw table")
        if raw is None:
            raise StreamError("nothing reads raw tables")
        values = np.asarray(raw(b, kind), dtype=float)
        if values.size != 3 * SIZES[kind][0] * SIZES[kind][1] or (values <= 0).any():
            raise StreamError("a raw table")
        return Encoding(mode, values, unit=unit)
    return Encoding("default")


def read_encodings(b: Bits, raw: Callable[[Bits, str], np.ndarray] | None = None) -> dict[str, Encoding]:
    """All kinds, in the order of SIZES."""
    return {k: Encoding("default") for k in SIZES} if b.flag() else {k: read_encoding(b, k, raw) for k in SIZES}


def write_encoding(s: BitSink, e: Encoding, raw: Callable[[BitSink, np.ndarray], None] | None = None) -> None:
    s.write(3, MODES.index(e.mode))
    if e.mode in _COUNTS:
        for row in e.values:
            for k, v in enumerate(row):
                s.f16(v / 64 if k < _SCALED.get(e.mode, 0) else v)
    if e.mode == "raw":
        s.f16(e.unit)
        raw(s, e.values)
    for bands in (e.bands, e.more):
        if bands is not None:
            s.write(4, bands.shape[1] - 1)
            for row in bands:
                for k, v in enumerate(row):
                    s.f16(v / 64 if k == 0 else v)


def write_encodings(s: BitSink, given: dict[str, Encoding], raw: Callable[[BitSink, np.ndarray], None] | None = None) -> None:
    s.write(1, not given)
    for k in SIZES if given else ():
        write_encoding(s, given.get(k, Encoding("default")), raw)
