"""Images in block transforms: low-frequency samples, the map of blocks, and coefficients under contexts that follow them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tessera.bitstream.bits import Bits, BitSink, StreamError, ceil_log2, pack_signed, unpack_signed
from tessera.bitstream.entropy import Code, Reader, encode, read_context_map, tokens_of, write_tokens
from tessera.bitstream.modular import Node, decode_stream, encode_stream
from tessera.operators.vardct import natural_order, size_of

# The kinds of block in the order of their numbers.
KINDS = (
    "dct8x8", "identity", "dct2x2", "dct4x4", "dct16x16", "dct32x32", "dct16x8", "dct8x16", "dct32x8", "dct8x32", "dct32x16", "dct16x32", "dct4x8", "dct8x4",
    "corner0", "corner1", "corner2", "corner3", "dct64x64", "dct64x32", "dct32x64", "dct128x128", "dct128x64", "dct64x128", "dct256x256", "dct256x128", "dct128x256",
)


def _shape(kind: str) -> tuple:
    return ("special",) if kind != "dct8x8" and size_of(kind) == (8, 8) else tuple(sorted(size_of(kind)))


_SHAPES = list(dict.fromkeys(map(_shape, KINDS)))
#: Kinds of one shape share their orders and contexts: a block, its turned twin, all special kinds.
SHAPE = {k: _SHAPES.index(_shape(k)) for k in KINDS}


def quant_kind(kind: str) -> str:
    """The name of a kind's table of weights."""
    if kind.startswith("corner"):
        return "corner"
    if kind.startswith("dct"):
        a, b = sorted(map(int, kind[3:].split("x")))
        return f"dct{a}x{b}"
    return kind


def order_of(kind: str) -> np.ndarray:
    rows, cols = size_of(kind)
    return natural_order(max(rows, cols) // 8, min(rows, cols) // 8)


# contexts

NONZERO, DENSITY = 37, 458
# The default map of (channel, shape) to contexts, channels in the order Y, X, B; offsets by how many coefficients are left.
DEFAULT_MAP = [
    0, 1, 2, 2, 3, 3, 4, 5, 6, 6, 6, 6, 6,
    7, 8, 9, 9, 10, 11, 12, 13, 14, 14, 14, 14, 14,
    7, 8, 9, 9, 10, 11, 12, 13, 14, 14, 14, 14, 14,
]
LEFT, LEFT_OFFSET = (1, 2, 4, 8, 12, 20, 32, 63), (0, 31, 62, 93, 123, 152, 180, 206)


def _place_context(k: int) -> int:
    """Every place up to the 15th has its own, later ones share one in twos, then in fours."""
    return k - 1 if k < 16 else 15 + (k - 16) // 2 if k < 32 else 23 + (k - 32) // 4


def _up(n: int, parts: int) -> int:
    return -(-n // parts)


@dataclass(frozen=True)
class Contexts:
    """Of a block: by its channel and shape, its quantisation and the low-frequency samples it covers."""

    map: list[int] = field(default_factory=lambda: list(DEFAULT_MAP))
    lf: tuple = ((), (), ())  # thresholds of each channel's low-frequency integers
    quant: tuple = ()

    @property
    def n(self) -> int:
        return max(self.map) + 1

    @property
    def total(self) -> int:
        return self.n * (NONZERO + DENSITY)

    @property
    def n_lf(self) -> int:
        return int(np.prod([len(t) + 1 for t in self.lf]))

    @staticmethod
    def read_from(b: Bits) -> Contexts:
        if b.flag():
            return Contexts()
        lf = tuple(tuple(unpack_signed(b.u32((4, 0), (8, 16), (16, 272), (32, 65808))) for _ in range(b.read(4))) for _ in range(3))
        quant = tuple(b.u32((2, 1), (3, 5), (5, 13), (8, 45)) for _ in range(b.read(4)))
        size = (len(quant) + 1) * int(np.prod([len(t) + 1 for t in lf]))
        if size > 64:
            raise StreamError("too many thresholds of blocks")
        out = Contexts(read_context_map(b, 3 * len(_SHAPES) * size), lf, quant)
        if out.n > 16:
            raise StreamError("too many contexts of blocks")
        return out

    def of(self, lf: int, quant: int, kind: str, channel: int) -> int:
        at = (1, 0, 2)[channel] * len(_SHAPES) + SHAPE[kind]
        at = at * (len(self.quant) + 1) + sum(quant > t for t in self.quant)
        return self.map[at * self.n_lf + lf]

    def of_count(self, block: int, predicted: int) -> int:
        return (predicted if predicted < 8 else 4 + predicted // 2 if predicted < 64 else 36) * self.n + block

    def of_coefficient(self, block: int, left: int, k: int, area: int, after: bool) -> int:
        """left and k are shared among the block's 8x8 parts; after: whether the coefficient before this one isn't 0."""
        offset = LEFT_OFFSET[bisect_left(LEFT, _up(left, area))] + _place_context(k // area)
        return self.n * NONZERO + DENSITY * block + 2 * offset + after


def lf_index(contexts: Contexts, lf: list[np.ndarray]) -> np.ndarray:
    """Of low-frequency integers X, Y, B of equal sizes: how many thresholds each passes, as one number."""
    x, y, b = (sum((v > t for t in ts), np.zeros(v.shape, np.int64)) for v, ts in zip(lf, contexts.lf))
    return (x * (len(contexts.lf[2]) + 1) + b) * (len(contexts.lf[1]) + 1) + y


# low-frequency samples and the map of blocks


def read_lf(b: Bits, rows: int, cols: int, factors: tuple, from_y: tuple = (0.0, 1.0), shared: tuple | None = None, bits: int = 8, stream: int = 0, shifts: tuple = ((0, 0),) * 3) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(integers, samples) of X, Y, B for rows x cols blocks. factors: what an integer is worth; from_y: Y's share of X and B, which only
    channels of full size have; shifts: (down, right) of subsampled channels."""
    unit = 1 / (1 << b.read(2))
    y, x, blue = decode_stream(b, [(rows >> shifts[c][0], cols >> shifts[c][1]) for c in (1, 0, 2)], bits, stream, shared)
    whole = [x, y, blue]
    out = [v * (f * unit) for v, f in zip(whole, factors)]
    if not any(map(any, shifts)):
        out[0] = out[0] + out[1] * from_y[0]
        out[2] = out[2] + out[1] * from_y[1]
    return whole, out


@dataclass
class BlockMap:
    blocks: list[tuple[int, int, str, int]]  # (row, column, kind, quantisation), rows and columns in 8s, in reading order
    sharpness: np.ndarray
    x_from_y: np.ndarray
    b_from_y: np.ndarray


def placed(kinds: list[str], rows: int, cols: int) -> list[tuple[int, int]]:
    """Where blocks go: each to the first free place, whole inside the image and one group of 32x32."""
    free, out, waiting = np.ones((rows, cols), bool), [], iter(kinds)
    for y in range(rows):
        for x in range(cols):
            if free[y, x]:
                kind = next(waiting, None)
                if kind is None:
                    raise StreamError("blocks don't cover the image")
                h, w = (n // 8 for n in size_of(kind))
                if y + h > min(rows, (y // 32 + 1) * 32) or x + w > min(cols, (x // 32 + 1) * 32) or not free[y : y + h, x : x + w].all():
                    raise StreamError("a block leaves its group or lies on another")
                free[y : y + h, x : x + w] = False
                out.append((y, x))
    return out


def _map_shapes(rows: int, cols: int, count: int) -> list[tuple[int, int]]:
    return [(_up(rows, 8), _up(cols, 8))] * 2 + [(2, count), (rows, cols)]


def read_map(b: Bits, rows: int, cols: int, shared: tuple | None = None, bits: int = 8, stream: int = 0) -> BlockMap:
    count = b.read(ceil_log2(rows * cols)) + 1
    x_from_y, b_from_y, what, sharpness = decode_stream(b, _map_shapes(rows, cols, count), bits, stream, shared)
    if ((sharpness < 0) | (sharpness > 7)).any() or ((what[0] < 0) | (what[0] >= len(KINDS))).any():
        raise StreamError("a block's sharpness or kind")
    kinds, quant = [KINDS[k] for k in what[0]], 1 + np.clip(what[1], 0, 255)
    blocks = [(*at, k, int(q)) for at, k, q in zip(placed(kinds, rows, cols), kinds, quant)]
    return BlockMap(blocks, sharpness, np.clip(x_from_y, -128, 127), np.clip(b_from_y, -128, 127))


def write_map(s: BitSink, m: BlockMap) -> None:
    rows, cols = m.sharpness.shape
    s.write(ceil_log2(rows * cols), len(m.blocks) - 1)
    what = np.array([[KINDS.index(k) for _, _, k, _ in m.blocks], [q - 1 for *_, q in m.blocks]])
    encode_stream(s, [m.x_from_y, m.b_from_y, what, m.sharpness], [Node(predictor=0)])


# coefficients


def _walk(blocks: list, rows: int, cols: int, contexts: Contexts, orders: dict, lf: np.ndarray | None, shifts: tuple, count: Callable, coefficient: Callable) -> None:
    """Visits what a group codes: for each block Y, X and B, first how many coefficients aren't 0, then those up to the last such one."""
    seen = [np.zeros((_up(rows, 1 << v), _up(cols, 1 << h)), np.int64) for v, h in shifts]
    for i, (y, x, kind, quant) in enumerate(blocks):
        h, w = (n // 8 for n in size_of(kind))
        area = h * w
        for c in (1, 0, 2):
            down, right = shifts[c]
            sy, sx = y >> down, x >> right
            if (sy << down, sx << right) != (y, x):
                continue
            s = seen[c]
            around = [int(s[sy - 1, sx])] if sy else []
            around += [int(s[sy, sx - 1])] if sx else []
            block = contexts.of(0 if lf is None else int(lf[y, x]), quant, kind, c)
            left = count(contexts.of_count(block, _up(sum(around), len(around)) if around else 32), i, c)
            if left > 63 * area:
                raise StreamError("more coefficients than a block has")
            s[sy : sy + h, sx : sx + w] = _up(left, area)
            after, order = left <= 4 * area, orders[SHAPE[kind]][c]
            for k in range(area, 64 * area):
                if not left:
                    break
                after = coefficient(contexts.of_coefficient(block, left, k, area, after), i, c, order[k]) != 0
                left -= after
            if left:
                raise StreamError("fewer coefficients than were announced")


def default_orders(blocks: list) -> dict[int, list[np.ndarray]]:
    return {SHAPE[k]: [order_of(k)] * 3 for k in {k for _, _, k, _ in blocks}}


def read_coefficients(
    b: Bits, code: Code, blocks: list, rows: int, cols: int, contexts: Contexts = Contexts(), orders: dict | None = None, histograms: int = 1,
    lf: np.ndarray | None = None, shift: int = 0, shifts: tuple = ((0, 0),) * 3, before: list[np.ndarray] | None = None,
) -> list[np.ndarray]:
    """A group's [channel, place] for each block, added to what earlier passes gave. code holds the contexts of all histograms; shift: of
    this pass; orders: of each shape and channel, the natural one by default."""
    first = b.read(ceil_log2(histograms)) * contexts.total
    if first >= histograms * contexts.total:
        raise StreamError("a histogram that there isn't")
    out = before or [np.zeros((3, size_of(k)[0] * size_of(k)[1]), np.int64) for _, _, k, _ in blocks]
    reader = Reader(code, b)

    def coefficient(context, i, c, place):
        v = reader.read_signed(first + context) << shift
        out[i][c, place] += v
        return v

    _walk(blocks, rows, cols, contexts, orders or default_orders(blocks), lf, shifts, lambda context, i, c: reader.read(first + context), coefficient)
    reader.finish()
    return out


def write_coefficients(
    s: BitSink, groups: list[tuple[list[np.ndarray], list]], rows: int, cols: int, contexts: Contexts = Contexts(), orders: dict | None = None, histograms: int = 1, chosen: int = 0,
    lf: np.ndarray | None = None, shifts: tuple = ((0, 0),) * 3, prefix: bool = True,
) -> list[bytes]:
    """Distributions that fit all groups (values and blocks of each) into s, which is what a frame's global section holds; returns the
    groups' own bytes. The lowest coefficients aren't coded."""
    first, n, every = chosen * contexts.total, histograms * contexts.total, []
    for values, blocks in groups:
        order, pairs = orders or default_orders(blocks), []

        def count(context, i, c, values=values, blocks=blocks, order=order, pairs=pairs):
            v = values[i][c]
            left = int(np.count_nonzero(v[order[SHAPE[blocks[i][2]]][c][v.size // 64 :]]))
            pairs.append((first + context, left))
            return left

        def coefficient(context, i, c, place, values=values, pairs=pairs):
            v = int(values[i][c, place])
            pairs.append((first + context, pack_signed(v)))
            return v

        _walk(blocks, rows, cols, contexts, order, lf, shifts, count, coefficient)
        every.append(pairs)
    code = encode(BitSink(), [p for pairs in every for p in pairs], n, prefix, clusters=[k % 8 for k in range(n)])
    code.write_to(s)
    out = []
    for pairs in every:
        group = BitSink()
        group.write(ceil_log2(histograms), chosen)
        write_tokens(group, tokens_of(pairs, code), code)
        out.append(group.bytes())
    return out
