"""Modular sub-streams: decision trees over properties of a sample, fourteen predictors, transforms, and the decoder of whole channels.

Channels are int64 arrays (rows x columns) with a shift a side. encode_stream() makes streams for round trips."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from tessera.bitstream.bits import Bits, BitSink, StreamError, pack_signed
from tessera.bitstream.entropy import Code, Reader, encode

STATIC = 2  # the first properties, channel and stream, are the same for a whole channel
PROPERTIES = 16
WEIGHTED = 6  # the self-correcting predictor; its property is the last of the sixteen
#: Reciprocals of 1 to 64 in 24 bits.
SHARE = [(1 << 24) // (i + 1) for i in range(64)]


@dataclass(frozen=True)
class Node:
    """Inner: property, value, above (taken by greater values), rest. Leaf: predictor, offset, factor, context."""

    property: int = -1
    value: int = 0
    above: int = -1
    rest: int = -1
    predictor: int = 0
    offset: int = 0
    factor: int = 1
    context: int = 0


@dataclass(frozen=True)
class Weights:
    """Of the self-correcting predictor: error coefficients and largest weights of its four parts."""

    p: tuple = (16, 10, 7, 7, 7, 0, 0)
    w: tuple = (13, 12, 12, 12)

    @staticmethod
    def read_from(b: Bits) -> Weights:
        return Weights() if b.flag() else Weights(tuple(b.read(5) for _ in range(7)), tuple(b.read(4) for _ in range(4)))


class Corrected:
    """Four predictions weighted by their recent errors near the sample, in eighths."""

    def __init__(self, weights: Weights, width: int):
        self.weights, self.width = weights, width
        self.errors = [[[0] * (width + 2) for _ in range(4)] for _ in range(2)]  # of the row above, of this one
        self.true = [[0] * (width + 2) for _ in range(2)]

    def row(self) -> None:
        self.errors = [self.errors[1], [[0] * (self.width + 2) for _ in range(4)]]
        self.true = [self.true[1], [0] * (self.width + 2)]

    def predict(self, x: int, w: int, n: int, nw: int, ne: int, nn: int) -> tuple[int, int]:
        """(prediction, property): the largest of the errors around."""
        left, right = max(x - 1, 0), min(x + 1, self.width - 1)
        above, te = self.errors[0], self.true[0]
        e_w, e_n, e_nw, e_ne = self.true[1][x - 1] if x else 0, te[x], te[left], te[right]
        w, n, nw, ne, nn = 8 * w, 8 * n, 8 * nw, 8 * ne, 8 * nn
        p = self.weights.p
        self.each = (
            w + ne - n, n - ((e_n + e_w + e_ne) * p[0] >> 5), w - ((e_n + e_w + e_nw) * p[1] >> 5),
            n - (e_nw * p[2] + e_n * p[3] + e_ne * p[4] + (nn - n) * p[5] + (nw - w) * p[6] >> 5),
        )
        share = []
        for k in range(4):
            e = above[k][x] + above[k][right] + above[k][left] & 0xFFFFFFFF
            shift = max((e + 1).bit_length() - 6, 0)
            share.append(4 + (self.weights.w[k] * SHARE[e >> shift & 63] >> shift))
        down = sum(share).bit_length() - 5
        share = [s >> down for s in share]
        total = sum(share)
        self.guess = (sum(v * s for v, s in zip(self.each, share)) + (total >> 1) - 1) * SHARE[total - 1] >> 24
        if (e_n ^ e_w | e_n ^ e_nw) <= 0:
            self.guess = min(max(self.guess, min(w, n, ne)), max(w, n, ne))
        return self.guess + 3 >> 3, max((e_w, e_n, e_nw, e_ne), key=abs)

    def learn(self, x: int, v: int) -> None:
        v *= 8
        self.true[1][x] = self.guess - v
        for k in range(4):
            e = abs(self.each[k] - v) + 3 >> 3
            self.errors[1][k][x] = e
            self.errors[0][k][x + 1] += e  # the next sample sees it above itself


def half(v: int) -> int:
    return v // 2 if v >= 0 else -(-v // 2)


def clamped_gradient(w: int, n: int, nw: int) -> int:
    return min(max(w + n - nw, min(w, n)), max(w, n))


#: Of (w, n, nw, ne, ww, nn, nee).
PREDICTORS: list[Callable | None] = [
    lambda w, n, nw, ne, ww, nn, nee: 0,
    lambda w, n, nw, ne, ww, nn, nee: w,
    lambda w, n, nw, ne, ww, nn, nee: n,
    lambda w, n, nw, ne, ww, nn, nee: half(w + n),
    lambda w, n, nw, ne, ww, nn, nee: w if abs(n - nw) < abs(w - nw) else n,
    lambda w, n, nw, ne, ww, nn, nee: clamped_gradient(w, n, nw),
    None,
    lambda w, n, nw, ne, ww, nn, nee: ne,
    lambda w, n, nw, ne, ww, nn, nee: nw,
    lambda w, n, nw, ne, ww, nn, nee: ww,
    lambda w, n, nw, ne, ww, nn, nee: half(w + nw),
    lambda w, n, nw, ne, ww, nn, nee: half(n + nw),
    lambda w, n, nw, ne, ww, nn, nee: half(n + ne),
    lambda w, n, nw, ne, ww, nn, nee: _sixteenth(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8),
]


def _sixteenth(v: int) -> int:
    return v // 16 if v >= 0 else -(-v // 16)


def wrapped(v: int) -> int:
    return (v + (1 << 31) & 0xFFFFFFFF) - (1 << 31)


# trees


def read_tree(b: Bits, limit: int = 1 << 22) -> list[Node]:
    """Nodes breadth first. Every split must be possible: a value within the range that the splits above leave."""
    code = Code.read_from(b, 6)
    reader, out, open_ = Reader(code, b), [], 1
    leaves = 0
    while len(out) < open_:
        if open_ > limit:
            raise StreamError("a tree is too large")
        prop = reader.read(1) - 1
        if prop > 255:
            raise StreamError("a tree's property")
        if prop >= 0:
            out.append(Node(prop, reader.read_signed(0), open_, open_ + 1))
            open_ += 2
            continue
        predictor, offset, log, bits = reader.read(2), reader.read_signed(3), reader.read(4), reader.read(5)
        if predictor > 13 or log > 30 or bits + 1 << log > 0xFFFFFFFF:
            raise StreamError("a tree's leaf")
        out.append(Node(predictor=predictor, offset=offset, factor=bits + 1 << log, context=leaves))
        leaves += 1
        b.check()
    reader.finish()
    check_tree(out)
    return out


def check_tree(tree: list[Node], most: int = 2048) -> None:
    todo: list = [(0, {}, 0)]
    while todo:
        at, ranges, depth = todo.pop()
        node = tree[at]
        if node.property < 0:
            continue
        low, high = ranges.get(node.property, (-(1 << 31), (1 << 31) - 1))
        if depth > most or not low <= node.value < high:
            raise StreamError("a tree's split leaves nothing to one side")
        todo.append((node.above, ranges | {node.property: (node.value + 1, high)}, depth + 1))
        todo.append((node.rest, ranges | {node.property: (low, node.value)}, depth + 1))


def write_tree(s: BitSink, tree: list[Node]) -> None:
    values = []
    for n in tree:
        if n.property >= 0:
            values += [(1, n.property + 1), (0, pack_signed(n.value))]
        else:
            log = (n.factor & -n.factor).bit_length() - 1
            values += [(1, 0), (2, n.predictor), (3, pack_signed(n.offset)), (4, log), (5, (n.factor >> log) - 1)]
    encode(s, values, 6, clusters=list(range(6)))


def pruned(tree: list[Node], channel: int, stream: int) -> list[Node]:
    """The tree of one channel: splits on channel and stream are decided, what can't be reached is gone."""
    fixed, out = (channel, stream), []

    def settle(at):
        while 0 <= tree[at].property < STATIC:
            at = tree[at].above if fixed[tree[at].property] > tree[at].value else tree[at].rest
        return at

    queue = [settle(0)]
    for at in queue:
        n = tree[at]
        if n.property >= 0:
            n = replace(n, above=len(queue), rest=len(queue) + 1)
            queue += [settle(tree[at].above), settle(tree[at].rest)]
        out.append(n)
    return out


def kind_of(tree: list[Node]) -> str:
    """leaf: one context for all; plain: without self-correction; corrected: only by its property; general."""
    if len(tree) == 1:
        return "leaf"
    last = PROPERTIES - 1
    if all(n.property in (-1, last) for n in tree) and all(n.predictor == WEIGHTED for n in tree if n.property < 0):
        return "corrected"
    return "general" if any(n.property == last or (n.property < 0 and n.predictor == WEIGHTED) for n in tree) else "plain"


# channels


@dataclass
class Channel:
    v: np.ndarray
    shift: tuple = (0, 0)
    meta: bool = False

    @property
    def size(self) -> tuple:
        return self.v.shape


def references(earlier: list[Channel], like: Channel, n: int) -> list[np.ndarray]:
    """Four properties for each earlier channel of the same size and shift, the nearest first: |v|, v, |v - g|, v - g by its gradient g."""
    out = []
    for c in reversed(earlier):
        if len(out) >= n:
            break
        if c.size != like.size or c.shift != like.shift:
            continue
        v = c.v
        w = np.pad(v, ((0, 0), (1, 0)))[:, :-1]
        north = np.vstack([w[:1], v[:-1]])
        nw = np.pad(v, ((1, 0), (1, 0)))[:-1, :-1]
        nw[0], nw[:, 0] = w[0], w[:, 0]
        d = v - np.clip(w + north - nw, np.minimum(w, north), np.maximum(w, north))
        out += [np.abs(v), v, np.abs(d), d]
    return out[:n]


def walk(tree: list[Node], channel: Channel, earlier: list[Channel], index: int, stream: int, weights: Weights, sample: Callable) -> None:
    """Goes through a channel in raster order; sample(context, guess, factor, y, x) gives each value."""
    tree = pruned(tree, index, stream)
    kind = kind_of(tree)
    out = channel.v
    h, w = out.shape
    need = max((n.property for n in tree), default=-1) + 1 - PROPERTIES
    refs = references(earlier, channel, 4 * -(-need // 4)) if need > 0 else []
    corrected = Corrected(weights, w) if kind in ("corrected", "general") or tree[0].predictor == WEIGHTED else None
    prop = [0] * max(PROPERTIES + 4 * -(-max(need, 0) // 4), PROPERTIES)
    prop[0], prop[1] = index, stream
    up2, up = [0] * w, [0] * w
    for y in range(h):
        row = [0] * w
        prop[2:] = [0] * (len(prop) - 2)
        prop[2] = y
        if corrected:
            corrected.row()
        for x in range(w):
            west = row[x - 1] if x else up[0] if y else 0
            n = up[x] if y else west
            nw = up[x - 1] if x and y else west
            ne = up[x + 1] if y and x + 1 < w else n
            ww = row[x - 2] if x > 1 else west
            nn = up2[x] if y > 1 else n
            nee = up[x + 2] if y and x + 2 < w else ne
            guess = 0
            if corrected:
                guess, prop[15] = corrected.predict(x, west, n, nw, ne, nn)
            node = tree[0]
            if node.property >= 0:
                prop[3:15] = x, abs(n), abs(west), n, west, west - prop[9], west + n - nw, west - nw, nw - n, n - ne, n - nn, west - ww
                for k, r in enumerate(refs):
                    prop[PROPERTIES + k] = int(r[y, x])
                while node.property >= 0:
                    node = tree[node.above if prop[node.property] > node.value else node.rest]
            if node.predictor != WEIGHTED:
                guess = PREDICTORS[node.predictor](west, n, nw, ne, ww, nn, nee)
            row[x] = sample(node.context, guess + node.offset, node.factor, y, x)
            if corrected:
                corrected.learn(x, row[x])
        out[y] = row
        up2, up = up, row


def decode_channels(b: Bits, tree: list[Node], code: Code, channels: list[Channel], stream: int, weights: Weights) -> None:
    """Fills the channels from one entropy-coded stream; empty channels take part by number only."""
    reader = Reader(code, b, max((c.size[1] for c in channels if not c.meta), default=0))
    for i, c in enumerate(channels):
        if c.v.size:
            walk(tree, c, channels[:i], i, stream, weights, lambda context, guess, factor, y, x: wrapped(guess + factor * reader.read_signed(context)))
            b.check()
    reader.finish()


# transforms

_BEGIN = ((3, 0), (6, 8), (10, 72), (13, 1096))


@dataclass(frozen=True)
class Transform:
    kind: str  # rct, palette, squeeze
    begin: int = 0
    count: int = 3
    rct: int = 6
    colours: int = 0
    deltas: int = 0
    predictor: int = 0
    steps: tuple = ()  # of a squeeze: (horizontal, in place, begin, count)


def read_transform(b: Bits) -> Transform:
    kind = b.read(2)
    if kind == 0:
        begin, rct = b.u32(*_BEGIN), b.u32((0, 6), (2, 0), (4, 2), (6, 10))
        if rct > 41:
            raise StreamError("colour transform")
        return Transform("rct", begin, 3, rct)
    if kind == 1:
        t = Transform("palette", b.u32(*_BEGIN), b.u32((0, 1), (0, 3), (0, 4), (13, 1)), 0, b.u32((8, 0), (10, 256), (12, 1280), (16, 5376)), b.u32((0, 0), (8, 1), (10, 257), (16, 1281)), b.read(4))
        if t.predictor > 13:
            raise StreamError("a palette's predictor")
        return t
    if kind == 2:
        return Transform("squeeze", steps=tuple((b.flag(), b.flag(), b.u32(*_BEGIN), b.u32((0, 1), (0, 2), (0, 3), (4, 4))) for _ in range(b.u32((0, 0), (4, 1), (6, 9), (8, 41)))))
    raise StreamError("transform")


def write_transform(s: BitSink, t: Transform) -> None:
    s.write(2, ("rct", "palette", "squeeze").index(t.kind))
    if t.kind == "squeeze":
        s.u32(len(t.steps), (0, 0), (4, 1), (6, 9), (8, 41))
        for horizontal, in_place, begin, count in t.steps:
            s.write(1, horizontal)
            s.write(1, in_place)
            s.u32(begin, *_BEGIN)
            s.u32(count, (0, 1), (0, 2), (0, 3), (4, 4))
        return
    s.u32(t.begin, *_BEGIN)
    if t.kind == "rct":
        s.u32(t.rct, (0, 6), (2, 0), (4, 2), (6, 10))
    else:
        s.u32(t.count, (0, 1), (0, 3), (0, 4), (13, 1))
        s.u32(t.colours, (8, 0), (10, 256), (12, 1280), (16, 5376))
        s.u32(t.deltas, (0, 0), (8, 1), (10, 257), (16, 1281))
        s.write(4, t.predictor)


def default_steps(shapes: list[tuple[int, int]], meta: int = 0) -> tuple:
    """The squeezes of an image whose channels have these (rows, columns): chroma once if it is as large as the first channel, then all
    channels, the longer side first, until eight samples a side are left."""
    h, w = shapes[meta]
    n, out = len(shapes) - meta, []
    if n > 2 and shapes[meta + 1] == (h, w):
        out += [(horizontal, False, meta + 1, 2) for horizontal, size in ((True, w), (False, h)) if size > 1]
    horizontal = w > h
    while max(w, h) > 8:
        if (w if horizontal else h) > 8:
            out.append((horizontal, True, meta, n))
            w, h = (-(-w // 2), h) if horizontal else (w, -(-h // 2))
        horizontal = not horizontal
    return tuple(out)


def planned(channels: list[Channel], transforms: list[Transform]) -> tuple[list[Channel], list[Transform]]:
    """The channels that a stream holds in place of these, and the transforms with their default steps filled in."""
    now, done = list(channels), []
    for t in transforms:
        if t.kind == "squeeze" and not t.steps:
            t = replace(t, steps=default_steps([c.size for c in now], sum(c.meta for c in now)))
        done.append(t)
        if t.kind == "rct":
            if t.begin + 3 > len(now) or len({c.size for c in now[t.begin : t.begin + 3]}) > 1:
                raise StreamError("colour transform of unequal channels")
        elif t.kind == "palette":
            if t.begin + t.count > len(now) or len({c.size for c in now[t.begin : t.begin + t.count]}) > 1:
                raise StreamError("palette of unequal channels")
            table = Channel(np.zeros((t.count, t.colours + t.deltas), np.int64), (-1, -1), True)
            now = [table, *now[: t.begin + 1], *now[t.begin + t.count :]]
        else:
            for horizontal, in_place, begin, count in t.steps:
                if begin + count > len(now):
                    raise StreamError("a squeeze beyond the channels")
                rest = []
                for i in range(begin, begin + count):
                    c = now[i]
                    h, w = c.size
                    size, other = ((h, -(-w // 2)), (h, w // 2)) if horizontal else ((-(-h // 2), w), (h // 2, w))
                    shift = tuple(s + (k == (0 if horizontal else 1)) for k, s in enumerate(c.shift))
                    now[i] = Channel(np.zeros(size, np.int64), shift, c.meta)
                    rest.append(Channel(np.zeros(other, np.int64), shift, c.meta))
                at = begin + count if in_place else len(now)
                now[at:at] = rest
    return now, done


def tendency(before: np.ndarray, mean: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The difference that a smooth curve through three means would have in the middle one; 0 where they aren't monotone.

    It is odd in its arguments, so only falling curves are worked out: about a third of (4 before - 3 after - mean) / 4, but the even part
    of the two samples' distance from their mean must not pass the means beside them."""
    sign = np.sign(before - after)
    b, m, a = sign * before, sign * mean, sign * after
    t = (4 * b - 3 * a - m + 6) // 12
    t = np.where(t // 2 > b - m, 2 * (b - m) + 1, t)
    t = np.where((t + 1) // 2 > m - a, 2 * (m - a), t)
    return np.where((b >= m) & (m >= a), sign * t, 0)


def unsqueeze_rows(mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Means and residuals of pairs (rows x columns) back to samples: all rows at once, column by column."""
    n, k = mean.shape[1], rest.shape[1]
    out = np.zeros((mean.shape[0], n + k), np.int64)
    before = mean[:, 0] if n else None
    for i in range(k):
        m = mean[:, i]
        d = rest[:, i] + tendency(before, m, mean[:, i + 1] if i + 1 < n else m)
        first = m + np.where(d < 0, -(-d // 2), d // 2)
        out[:, 2 * i], out[:, 2 * i + 1] = first, first - d
        before = first - d
    if n > k:
        out[:, -1] = mean[:, -1]
    return out


def squeeze_rows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of unsqueeze_rows."""
    k = v.shape[1] // 2
    a, b = v[:, 0 : 2 * k : 2], v[:, 1 : 2 * k : 2]
    mean = (a + b + (a > b)) >> 1
    if v.shape[1] % 2:
        mean = np.hstack([mean, v[:, -1:]])
    rest = np.zeros((v.shape[0], k), np.int64)
    for i in range(k):
        before = b[:, i - 1] if i else mean[:, 0]
        rest[:, i] = a[:, i] - b[:, i] - tendency(before, mean[:, i], mean[:, i + 1] if i + 1 < mean.shape[1] else mean[:, i])
    return mean, rest


#: Where the three results of a colour transform go.
ORDERS = ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0))


def undo_rct(a: np.ndarray, b: np.ndarray, c: np.ndarray, kind: int) -> list[np.ndarray]:
    order, op = ORDERS[kind // 7], kind % 7
    if op == 6:
        t = a - (c >> 1)
        last = t - (b >> 1)
        three = [last + b, c + t, last]
    else:
        c = c + a if op & 1 else c
        b = b + a if op >> 1 == 1 else b + ((a + c) >> 1) if op >> 1 == 2 else b
        three = [a, b, c]
    out: list = [None] * 3
    for k, v in zip(order, three):
        out[k] = v
    return out


def do_rct(channels: list[np.ndarray], kind: int) -> list[np.ndarray]:
    order, op = ORDERS[kind // 7], kind % 7
    a, b, c = (channels[k] for k in order)
    if op == 6:
        d = a - c
        t = c + (d >> 1)
        return [t + ((b - t) >> 1), d, b - t]
    b = b - a if op >> 1 == 1 else b - ((a + c) >> 1) if op >> 1 == 2 else b
    return [a, b, c - a if op & 1 else c]


# Red, green and blue of the differences that negative indices stand for.
DELTAS = np.array(
    """0 0 0, 4 4 4, 11 0 0, 0 0 -13, 0 -12 0, -10 -10 -10, -18 -18 -18, -27 -27 -27, -18 -18 0, 0 0 -32, -32 0 0, -37 -37 -37,
    0 -32 -32, 24 24 45, 50 50 50, -45 -24 -24, -24 -45 -45, 0 -24 -24, -34 -34 0, -24 0 -24, -45 -45 -24, 64 64 64, -32 0 -32, 0 -32 0,
    -32 0 32, -24 -45 -24, 45 24 45, 24 -24 -45, -45 -24 24, 80 80 80, 64 0 0, 0 0 -64, 0 -64 -64, -24 -24 45, 96 96 96, 64 64 0,
    45 -24 -24, 34 -34 0, 112 112 112, 24 -45 -45, 45 45 -24, 0 -32 32, 24 -24 45, 0 96 96, 45 -24 24, 24 -45 -24, -24 -45 24, 0 -64 0,
    96 0 0, 128 128 128, 64 0 64, 144 144 144, 96 96 0, -36 -36 36, 45 -24 -45, 45 -45 -24, 0 0 -96, 0 128 128, 0 96 0, 45 24 -45,
    -128 0 0, 24 -45 24, -45 24 -45, 64 0 -64, 64 -64 -64, 96 0 96, 45 -45 24, 24 45 -45, 64 64 -64, 128 128 0, 0 0 -128, -24 45 -45""".replace(",", " ").split(),
    dtype=np.int64,
).reshape(-1, 3)


def implicit_delta(index: np.ndarray, c: int, bits: int) -> np.ndarray:
    """Of negative indices: -1 is no difference, then each row of the table as it is and negated, over and over; deeper samples scale it."""
    turn = (-1 - index) % (2 * len(DELTAS) - 1)
    return DELTAS[(turn + 1) // 2, c] * np.where(turn % 2, 1, -1) << max(0, min(bits, 24) - 8)


def colour_of(index: np.ndarray, table: np.ndarray, c: int, bits: int) -> np.ndarray:
    """Entries of a palette, and beyond it the implicit ones: a cube of four levels a channel, then one of five; before it differences."""
    n = table.shape[1]
    top = (1 << min(bits, 24)) - 1
    small = index - n
    four = (small >> 2 * min(c, 2) & 3) * top // 4 + (1 << max(0, min(bits, 24) - 3))
    five = (small - 64) // 5 ** min(c, 2) % 5 * top // 4
    known = table[c][np.clip(index, 0, max(n - 1, 0))] if n else np.zeros_like(index)
    implied = np.where(index < 0, implicit_delta(index, c, bits), np.where(small < 64, four, five)) if c < 3 else 0
    return np.where((index >= 0) & (index < n), known, implied)


def undo_palette(table: np.ndarray, index: Channel, t: Transform, bits: int, weights: Weights) -> list[Channel]:
    """Indices to colours; below t.deltas, and so for all negative ones, an entry is added to the prediction of its channel."""
    out = []
    for c in range(t.count):
        value = Channel(colour_of(index.v, table, c, bits), index.shift)
        if t.deltas or t.predictor:
            entry, delta = value.v.copy(), index.v < t.deltas
            leaf = [Node(predictor=t.predictor)]
            walk(leaf, value, [], 0, 0, weights, lambda _, guess, factor, y, x, e=entry, d=delta: wrapped(int(e[y, x]) + (guess if d[y, x] else 0)))
        out.append(value)
    return out


def undo(channels: list[Channel], transforms: list[Transform], bits: int, weights: Weights) -> list[Channel]:
    """The transforms of planned(), the last one first."""
    now = list(channels)
    for t in reversed(transforms):
        if t.kind == "rct":
            three = undo_rct(*[c.v for c in now[t.begin : t.begin + 3]], t.rct)
            now[t.begin : t.begin + 3] = [replace(c, v=v) for c, v in zip(now[t.begin : t.begin + 3], three)]
        elif t.kind == "palette":
            at = t.begin + 1
            now[at : at + 1] = undo_palette(now[0].v, now[at], t, bits, weights)
            del now[0]
        else:
            for horizontal, in_place, begin, count in reversed(t.steps):
                at = begin + count if in_place else len(now) - count
                rest = now[at : at + count]
                del now[at : at + count]
                for i, r in enumerate(rest):
                    c = now[begin + i]
                    v = unsqueeze_rows(c.v, r.v) if horizontal else unsqueeze_rows(c.v.T, r.v.T).T
                    now[begin + i] = Channel(v, tuple(s - (k == (0 if horizontal else 1)) for k, s in enumerate(c.shift)), c.meta)
    return now


# sub-streams


def decode_stream(b: Bits, shapes: list[tuple[int, int]], bits: int = 8, stream: int = 0, shared: tuple | None = None) -> list[np.ndarray]:
    """A whole sub-stream to its channels: header, tree (or the shared one with its code), samples, inverse transforms."""
    use_shared = b.flag()
    weights = Weights.read_from(b)
    transforms = [read_transform(b) for _ in range(b.u32((0, 0), (0, 1), (4, 2), (8, 18)))]
    channels, transforms = planned([Channel(np.zeros(s, np.int64)) for s in shapes], transforms)
    if use_shared:
        if shared is None:
            raise StreamError("there is no shared tree")
        tree, code = shared
    else:
        tree = read_tree(b)
        code = Code.read_from(b, (len(tree) + 1) // 2)
    decode_channels(b, tree, code, channels, stream, weights)
    return [c.v for c in undo(channels, transforms, bits, weights)]


def encode_stream(s: BitSink, arrays: list[np.ndarray], tree: list[Node], transforms: list[Transform] = [], prefix: bool = True, stream: int = 0, copies: tuple | None = None) -> None:  # noqa: B006
    """Channels through the transforms (colour transforms and squeezes) and the tree into a sub-stream."""
    s.write(1, 0)
    s.write(1, 1)
    s.u32(len(transforms), (0, 0), (0, 1), (4, 2), (8, 18))
    for t in transforms:
        write_transform(s, t)
    _, plan = planned([Channel(np.zeros_like(a)) for a in arrays], transforms)
    now = [Channel(np.asarray(a, np.int64)) for a in arrays]
    for t in plan:
        if t.kind == "rct":
            now[t.begin : t.begin + 3] = [replace(c, v=v) for c, v in zip(now[t.begin : t.begin + 3], do_rct([c.v for c in now[t.begin : t.begin + 3]], t.rct))]
        elif t.kind == "palette":
            flat = np.stack([c.v.ravel() for c in now[t.begin : t.begin + t.count]])
            table, index = np.unique(flat, axis=1, return_inverse=True)
            if table.shape[1] != t.colours or t.deltas or t.predictor:
                raise ValueError("only palettes of exactly the colours that occur are written")
            first = now[t.begin]
            now = [Channel(table, (-1, -1), True), *now[: t.begin], replace(first, v=index.reshape(first.size).astype(np.int64)), *now[t.begin + t.count :]]
        else:
            for horizontal, in_place, begin, count in t.steps:
                rest = []
                for i in range(begin, begin + count):
                    c = now[i]
                    m, r = squeeze_rows(c.v) if horizontal else [x.T for x in squeeze_rows(c.v.T)]
                    shift = tuple(x + (k == (0 if horizontal else 1)) for k, x in enumerate(c.shift))
                    now[i] = Channel(m, shift)
                    rest.append(Channel(r, shift))
                at = begin + count if in_place else len(now)
                now[at:at] = rest
    write_tree(s, tree)
    values: list = []
    for i, c in enumerate(now):
        if c.v.size:
            true = c.v.copy()

            def sample(context, guess, factor, y, x, true=true):
                d = int(true[y, x]) - guess
                if d % factor:
                    raise ValueError("a factor that samples don't follow")
                values.append((context, pack_signed(d // factor)))
                return int(true[y, x])

            walk(tree, Channel(np.zeros_like(c.v), c.shift, c.meta), now[:i], i, stream, Weights(), sample)
    leaves = (len(tree) + 1) // 2
    encode(s, values, leaves, prefix, copies=copies, clusters=[min(i, 7) for i in range(leaves)])
