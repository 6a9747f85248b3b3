"""Entropy-coded streams: prefix codes, range asymmetric numeral systems with alias tables, context maps, copies of earlier symbols.

A Code holds the distributions of a stream; a Reader goes through one. Code.write and Encoder make streams, for round trips."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from tessera.bitstream.bits import Bits, BitSink, StreamError, ceil_log2, unpack_signed

TOTAL_BITS, TOTAL = 12, 1 << 12
FINAL_STATE = 0x130000
WINDOW = 1 << 20
# The format's prefix code for the logarithms of counts (symbol 13 repeats), as code lengths and codes.
LOG_LENGTHS = (5, 4, 4, 4, 4, 4, 3, 3, 3, 3, 3, 6, 7, 7)
LOG_CODES = (17, 11, 15, 3, 9, 7, 4, 2, 5, 6, 0, 33, 1, 65)
# The order in which lengths of code lengths come, and their code (length, by the next four bits).
LENGTH_ORDER = (1, 2, 3, 4, 0, 5, 17, 6, 16, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODE = ((2, 0), (2, 4), (2, 3), (3, 2), (2, 0), (2, 4), (2, 3), (4, 1), (2, 0), (2, 4), (2, 3), (3, 2), (2, 0), (2, 4), (2, 3), (4, 5))
# Distances (dx, dy) that the first 120 codes stand for in an image of known width.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


@dataclass(frozen=True)
class Split:
    """How integers divide into a token and plain bits: below 1 << exponent whole, above by their top `msb` and low `lsb` bits."""

    exponent: int = 4
    msb: int = 2
    lsb: int = 0

    @staticmethod
    def read_from(b: Bits, log_alphabet: int) -> Split:
        exponent = b.read(ceil_log2(log_alphabet + 1))
        if exponent == log_alphabet:
            return Split(exponent, 0, 0)
        msb = b.read(ceil_log2(exponent + 1))
        lsb = b.read(ceil_log2(exponent - msb + 1)) if msb <= exponent else exponent
        if exponent > log_alphabet or msb + lsb > exponent:
            raise StreamError("a token's parts are larger than the token")
        return Split(exponent, msb, lsb)

    def write_to(self, s: BitSink, log_alphabet: int) -> None:
        s.write(ceil_log2(log_alphabet + 1), self.exponent)
        if self.exponent != log_alphabet:
            s.write(ceil_log2(self.exponent + 1), self.msb)
            s.write(ceil_log2(self.exponent - self.msb + 1), self.lsb)

    def value(self, token: int, b: Bits) -> int:
        base = 1 << self.exponent
        if token < base:
            return token
        inside = self.msb + self.lsb
        n = self.exponent - inside + (token - base >> inside)
        if n > 31:
            raise StreamError("a number has more than 32 bits")
        high = token >> self.lsb & ((1 << self.msb) - 1) | 1 << self.msb
        return (high << n | b.read(n)) << self.lsb | token & ((1 << self.lsb) - 1)

    def token(self, value: int) -> tuple[int, int, int]:
        """(token, number of plain bits, plain bits)."""
        base = 1 << self.exponent
        if value < base:
            return value, 0, 0
        top = value.bit_length() - 1
        n = top - self.msb - self.lsb
        high = value >> (top - self.msb) & ((1 << self.msb) - 1)
        low = value & ((1 << self.lsb) - 1)
        return base + (top - self.exponent << self.msb + self.lsb) + (high << self.lsb) + low, n, value >> self.lsb & ((1 << n) - 1)


def _mirrored(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (length, code with its first bit lowest), shorter codes first, then by symbol."""
    out, code, before = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[symbol] = (n, _mirrored(code, n))
        code += 1
    return out


class PrefixCode:
    """A prefix code; read by one look into a table of all continuations of its longest code."""

    def __init__(self, lengths: list[int], only: int | None = None):
        self.codes, self.single = canonical(lengths), only
        if only is not None:
            self.codes = {only: (0, 0)}
        self.bits = max((n for n, _ in self.codes.values()), default=0)
        self.table = [(0, 0)] * (1 << self.bits)
        for symbol, (n, code) in self.codes.items():
            self.table[code :: 1 << n] = [(symbol, n)] * (1 << self.bits - n)

    def read(self, b: Bits) -> int:
        symbol, n = self.table[b.peek(self.bits)]
        b.at += n
        return symbol

    @staticmethod
    def read_from(b: Bits, size: int) -> PrefixCode:
        if size == 1:
            return PrefixCode([], 0)
        hidden = b.read(2)
        if hidden == 1:
            bits, count = ceil_log2(size), b.read(2) + 1
            symbols = [b.read(bits) for _ in range(count)]
            if max(symbols) >= size or len(set(symbols)) < count:
                raise StreamError("symbols of a simple code")
            shape = {1: [0], 2: [1, 1], 3: [1, 2, 2], 4: [2, 2, 2, 2]}[count]
            if count == 4 and b.read(1):
                shape = [1, 2, 3, 3]
            lengths = [0] * size
            for s, n in zip(symbols, shape):
                lengths[s] = n
            return PrefixCode(lengths, symbols[0] if count == 1 else None)
        inner, room, used = [0] * 18, 32, 0
        for at in LENGTH_ORDER[hidden:]:
            if room <= 0:
                break
            n, length = LENGTH_CODE[b.peek(4)]
            b.at += n
            inner[at] = length
            if length:
                room -= 32 >> length
                used += 1
        if room and used != 1:
            raise StreamError("code lengths do not fill their space")
        code = PrefixCode(inner, next(i for i, n in enumerate(inner) if n) if used == 1 else None)
        lengths, before, room, last, run = [], 8, 32768, 0, 0
        while len(lengths) < size and room > 0:
            s = code.read(b)
            if s < 16:
                lengths.append(s)
                last = run = 0
                if s:
                    before = s
                    room -= 32768 >> s
                continue
            extra, length = (2, before) if s == 16 else (3, 0)
            if last != s or length != (lengths[-1] if lengths else -1):
                run = 0
            old, last = run, s
            run = (run - 2 << extra if run else 0) + 3 + b.read(extra)
            if len(lengths) + run - old > size:
                raise StreamError("a run of code lengths is too long")
            lengths += [length] * (run - old)
            if length:
                room -= (run - old) * (32768 >> length)
        if room:
            raise StreamError("codes do not fill their space")
        return PrefixCode(lengths + [0] * (size - len(lengths)))

    @staticmethod
    def of_counts(counts: list[int]) -> PrefixCode:
        """A code of at most 15 bits for symbols with these counts: merged by weight; if that is too deep, by flatter weights."""
        some = [s for s, c in enumerate(counts) if c]
        if len(some) < 2:
            return PrefixCode([], some[0] if some else 0)
        import heapq

        floor = 1
        while True:
            heap = [(max(counts[s], floor), s, (s,)) for s in some]
            heapq.heapify(heap)
            lengths = [0] * len(counts)
            while len(heap) > 1:
                (x, i, a), (y, _, c) = heapq.heappop(heap), heapq.heappop(heap)
                for s in a + c:
                    lengths[s] += 1
                heapq.heappush(heap, (x + y, i, a + c))
            if max(lengths) <= 15:
                return PrefixCode(lengths)
            floor *= 2

    def write_to(self, s: BitSink, size: int) -> None:
        if size == 1:
            return
        if self.single is not None or len(self.codes) == 2:
            s.write(2, 1)
            symbols = sorted(self.codes)
            s.write(2, len(symbols) - 1)
            for x in symbols:
                s.write(ceil_log2(size), x)
            return
        s.write(2, 0)  # plain lengths, each behind a code of five bits or fewer for the lengths that occur
        lengths = [self.codes.get(x, (0, 0))[0] for x in range(size)]
        while lengths[-1] == 0:
            lengths.pop()
        used = sorted(set(lengths))
        depth = ceil_log2(len(used)) if len(used) > 1 else 1
        inner = [0] * 18
        for i, n in enumerate(used):
            inner[n] = depth
        for n in used[: (1 << depth) - len(used)]:  # the first ones have one bit less, so that the space is filled
            inner[n] -= 1
        if len(used) == 1:
            inner[used[0]] = 1
        coded = {0: (2, 0), 4: (2, 1), 3: (2, 2), 2: (3, 3), 1: (4, 7), 5: (4, 15)}
        room = 32
        for at in LENGTH_ORDER:
            if room <= 0:
                break
            s.write(*coded[inner[at]])
            room -= 32 >> inner[at] if inner[at] else 0
        codes = canonical(inner)
        for n in lengths if len(used) > 1 else []:
            s.write(*codes[n])


class AliasCode:
    """Counts that sum to 4096, as buckets of equal size in which at most two symbols meet."""

    def __init__(self, counts: list[int], log_alphabet: int):
        self.counts = counts + [0] * ((1 << log_alphabet) - len(counts))
        self.shift = TOTAL_BITS - log_alphabet
        size, self.single = 1 << self.shift, None
        full = [s for s, c in enumerate(counts) if c == TOTAL]
        if full:
            self.single = full[0]
            self.cut, self.other = [0] * len(self.counts), [full[0]] * len(self.counts)
            self.offset = [i * size for i in range(len(self.counts))]
            return
        self.cut, self.other, self.offset = list(self.counts), list(range(len(self.counts))), [0] * len(self.counts)
        small = [i for i, c in enumerate(self.cut) if c < size]
        large = [i for i, c in enumerate(self.cut) if c > size]
        while large:
            big, hole = large.pop(), small.pop()
            self.cut[big] -= size - self.cut[hole]
            self.other[hole] = big
            self.offset[hole] = self.cut[big] - self.cut[hole]
            (small if self.cut[big] < size else large if self.cut[big] > size else []).append(big)

    def place(self, at: int) -> tuple[int, int]:
        """(symbol, number among its places) of a place below 4096."""
        i, pos = at >> self.shift, at & ((1 << self.shift) - 1)
        return (i, pos) if pos < self.cut[i] else (self.other[i], self.offset[i] + pos)

    @staticmethod
    def read_from(b: Bits, log_alphabet: int) -> AliasCode:
        most = 1 << log_alphabet
        counts = [0] * most

        def fits(n):
            if n > most:
                raise StreamError("a distribution has too many symbols")
            return n

        if b.read(1):  # one symbol or two
            if b.read(1):
                x, y = b.varint8(), b.varint8()
                if x == y:
                    raise StreamError("a distribution of two equal symbols")
                fits(max(x, y) + 1)
                counts[x] = b.read(TOTAL_BITS)
                counts[y] = TOTAL - counts[x]
            else:
                x = b.varint8()
                fits(x + 1)
                counts[x] = TOTAL
        elif b.read(1):  # as even as can be
            n = fits(b.varint8() + 1)
            counts[:n] = [TOTAL // n + (i < TOTAL % n) for i in range(n)]
        else:
            AliasCode._read_counts(b, counts, fits)
        return AliasCode(counts, log_alphabet)

    @staticmethod
    def _read_counts(b: Bits, counts: list[int], fits) -> None:
        steps = 0
        while steps < 3 and b.read(1):
            steps += 1
        precision = b.read(steps) + (1 << steps) - 1
        if precision > TOTAL_BITS + 1:
            raise StreamError("precision of counts")
        n = fits(b.varint8() + 3)
        logs: list = []  # the logarithm of a count plus one, or None in a run that repeats the count before it
        while len(logs) < n:
            x, bits = _LOGS[b.peek(7)]
            b.at += bits
            logs += [x] if x != 13 else [None] * (b.varint8() + 4)
        fits(len(logs))
        if len(logs) > n or all(x is None for x in logs):
            raise StreamError("runs in a distribution")
        rest = max((i for i, x in enumerate(logs) if x is not None), key=lambda i: (logs[i], -i))  # its count is what remains
        if rest + 1 < n and logs[rest + 1] is None:
            raise StreamError("the count left out is repeated")
        before = total = 0
        for i, x in enumerate(logs):
            if x is None:
                counts[i] = before
            elif i == rest:
                before = 0
                continue
            elif x < 2:
                counts[i] = x
            else:
                known = min(max(precision - (TOTAL_BITS - (x - 1) >> 1), 0), x - 1)
                counts[i] = (1 << x - 1) + (b.read(known) << x - 1 - known)
            before = counts[i]
            total += before
            if total >= TOTAL:
                raise StreamError("counts of a distribution are too large")
        counts[rest] = TOTAL - total

    @staticmethod
    def of_counts(counts: list[int], log_alphabet: int) -> AliasCode:
        """Scaled to 4096: every symbol that occurs keeps a place, the most frequent takes the rounding."""
        total = sum(counts)
        if not total:
            return AliasCode([TOTAL], log_alphabet)
        out = [max(1, c * TOTAL // total) if c else 0 for c in counts]
        while sum(out) != TOTAL:
            top = max(range(len(out)), key=out.__getitem__)
            gap = TOTAL - sum(out)
            out[top] += gap if gap > 0 else max(gap, -(out[top] // 2))
        return AliasCode(out, log_alphabet)

    def write_to(self, s: BitSink) -> None:
        some = [i for i, c in enumerate(self.counts) if c]
        if len(some) <= 2:
            s.write(1, 1)
            s.write(1, len(some) - 1)
            for i in some:
                s.varint8(i)
            if len(some) == 2:
                s.write(TOTAL_BITS, self.counts[some[0]])
            return
        s.write(2, 0)
        s.write(3, 7)
        s.write(3, TOTAL_BITS + 1 - 7)  # all bits of all counts
        n = max(some[-1] + 1, 3)
        s.varint8(n - 3)
        logs = [c.bit_length() for c in self.counts[:n]]
        for x in logs:
            s.write(LOG_LENGTHS[x], LOG_CODES[x])
        rest = max(range(n), key=lambda i: (logs[i], -i))
        for i, x in enumerate(logs):
            if i != rest and x > 1:
                s.write(x - 1, self.counts[i] - (1 << x - 1))


_LOGS = [(0, 0)] * 128
for _x, (_n, _c) in enumerate(zip(LOG_LENGTHS, LOG_CODES)):
    _LOGS[_c :: 1 << _n] = [(_x, _n)] * (128 >> _n)


def inverse_move_to_front(indices: list[int]) -> list[int]:
    order, out = list(range(256)), []
    for i in indices:
        order.insert(0, order.pop(i))
        out.append(order[0])
    return out


def move_to_front(values: list[int]) -> list[int]:
    order, out = list(range(256)), []
    for v in values:
        out.append(order.index(v))
        order.insert(0, order.pop(out[-1]))
    return out


def read_context_map(b: Bits, n: int) -> list[int]:
    if b.read(1):
        bits = b.read(2)
        return [b.read(bits) for _ in range(n)]
    front, code = b.read(1), Code.read_from(b, 1, n > 2)
    reader = Reader(code, b)
    out = [reader.read(0) for _ in range(n)]
    reader.finish()
    if max(out) > 255:
        raise StreamError("a context map's entry is too large")
    out = inverse_move_to_front(out) if front else out
    if len(set(out)) != max(out) + 1:
        raise StreamError("a context map leaves out a distribution")
    return out


@dataclass
class Code:
    """The distributions of a stream. copies: (least token that copies, least length) or None; lengths: how copies' lengths divide."""

    clusters: list[int]
    splits: list[Split]
    codes: list
    log_alphabet: int = 15
    copies: tuple[int, int] | None = None
    lengths: Split | None = None

    @property
    def prefix(self) -> bool:
        return isinstance(self.codes[0], PrefixCode)

    @staticmethod
    def read_from(b: Bits, contexts: int, may_copy: bool = True) -> Code:
        copies = lengths = None
        if b.flag():
            if not may_copy:
                raise StreamError("copies are not allowed here")
            copies = b.u32((0, 224), (0, 512), (0, 4096), (15, 8)), b.u32((0, 3), (0, 4), (2, 5), (8, 9))
            lengths = Split.read_from(b, 8)
            contexts += 1
        clusters = read_context_map(b, contexts) if contexts > 1 else [0]
        prefix = b.flag()
        log_alphabet = 15 if prefix else 5 + b.read(2)
        n = max(clusters) + 1
        splits = [Split.read_from(b, log_alphabet) for _ in range(n)]
        if prefix:
            sizes = [b.varint16() + 1 for _ in range(n)]
            codes: list = [PrefixCode.read_from(b, s) for s in sizes]
        else:
            codes = [AliasCode.read_from(b, log_alphabet) for _ in range(n)]
        return Code(clusters, splits, codes, log_alphabet, copies, lengths)

    def write_to(self, s: BitSink) -> None:
        s.write(1, self.copies is not None)
        if self.copies:
            s.u32(self.copies[0], (0, 224), (0, 512), (0, 4096), (15, 8))
            s.u32(self.copies[1], (0, 3), (0, 4), (2, 5), (8, 9))
            self.lengths.write_to(s, 8)
        if len(self.clusters) > 1:
            bits = max(self.clusters).bit_length()
            if bits <= 3:
                s.write(1, 1)
                s.write(2, bits)
                for c in self.clusters:
                    s.write(bits, c)
            else:
                s.write(1, 0)
                s.write(1, 1)
                encode(s, [(0, v) for v in move_to_front(self.clusters)], 1)
        s.write(1, self.prefix)
        if not self.prefix:
            s.write(2, self.log_alphabet - 5)
        for x in self.splits:
            x.write_to(s, self.log_alphabet)
        if self.prefix:
            sizes = [max(c.codes) + 1 for c in self.codes]
            for n in sizes:
                s.varint16(n - 1)
            for c, n in zip(self.codes, sizes):
                c.write_to(s, n)
        else:
            for c in self.codes:
                c.write_to(s)


@dataclass
class Reader:
    """Goes through one stream of a Code. width: of the image whose samples come, for near distances."""

    code: Code
    bits: Bits
    width: int = 0
    state: int = FINAL_STATE
    left: int = 0  # symbols still to copy
    source: int = 0
    window: list[int] = field(default_factory=list)

    def __post_init__(self):
        c = self.code
        if not c.prefix:
            self.state = self.bits.read(32)
        far = c.clusters[-1]
        # copies of the last symbol only need no window
        self.repeats = bool(c.copies) and c.codes[far].single == 1 and c.splits[far].exponent == 0

    def _token(self, cluster: int) -> int:
        code, b = self.code.codes[cluster], self.bits
        if self.code.prefix:
            return code.read(b)
        symbol, at = code.place(self.state & TOTAL - 1)
        state = (self.state >> TOTAL_BITS) * code.counts[symbol] + at
        self.state = state << 16 | b.read(16) if state < 1 << 16 else state
        return symbol

    def read(self, context: int) -> int:
        return self.read_cluster(self.code.clusters[context])

    def read_signed(self, context: int) -> int:
        return unpack_signed(self.read_cluster(self.code.clusters[context]))

    def read_cluster(self, cluster: int) -> int:
        c, b = self.code, self.bits
        if c.copies is None:
            return c.splits[cluster].value(self._token(cluster), b)
        if not self.left:
            token = self._token(cluster)
            if token < c.copies[0]:
                return self._keep(c.splits[cluster].value(token, b))
            if not self.window:
                raise StreamError("a copy before any symbol")
            self.left = c.lengths.value(token - c.copies[0], b) + c.copies[1]
            far = c.clusters[-1]
            back = 1 if self.repeats else self._distance(c.splits[far].value(self._token(far), b))
            self.source = len(self.window) - min(back, len(self.window), WINDOW)
        self.left -= 1
        value = self.window[self.source]
        self.source += 0 if self.repeats else 1
        return self._keep(value)

    def _distance(self, code: int) -> int:
        if not self.width:
            return code + 1
        if code >= 120:
            return code - 119
        dx, dy = NEAR[code]
        return max(1, dx + self.width * dy)

    def _keep(self, value: int) -> int:
        if self.repeats:
            self.window[:] = [value]
            self.source = 0
        else:
            self.window.append(value)
            if len(self.window) > 4 * WINDOW:
                drop = len(self.window) - WINDOW - 1
                del self.window[:drop]
                self.source -= drop
        return value

    def checkpoint(self) -> tuple:
        """What restore() goes back to: the stream can be read again from here when more bytes have come."""
        return self.bits.at, self.state, self.left, self.source, copy.copy(self.window)

    def restore(self, at: tuple) -> None:
        self.bits.at, self.state, self.left, self.source = at[:4]
        self.window = copy.copy(at[4])

    def finish(self) -> None:
        self.bits.check()
        if not self.code.prefix and self.state != FINAL_STATE:
            raise StreamError("the stream ends in a wrong state")


def tokens_of(values: list[tuple[int, int]], code: Code) -> list[tuple[int, int, int, int]]:
    """(cluster, token, number of plain bits, plain bits); runs of equal values become copies of the last one if the code has copies."""
    out, i = [], 0
    while i < len(values):
        context, v = values[i]
        out.append((code.clusters[context], *code.splits[code.clusters[context]].token(v)))
        i += 1
        if code.copies:
            run = 0
            while i + run < len(values) and values[i + run][1] == v:
                run += 1
            if run >= code.copies[1]:
                token, n, bits = code.lengths.token(run - code.copies[1])
                out.append((code.clusters[values[i][0]], code.copies[0] + token, n, bits))
                far = code.clusters[-1]
                out.append((far, *code.splits[far].token(code_of_last(code))))
                i += run
    return out


def code_of_last(code: Code) -> int:
    """The distance code of the symbol before, without an image's width; 1 stands for it where a code only repeats."""
    return 1 if code.splits[code.clusters[-1]].exponent == 0 else 0


def encode(s: BitSink, values: list[tuple[int, int]], contexts: int, prefix: bool = True, split: Split = Split(), copies: tuple[int, int] | None = None, clusters: list[int] | None = None, only_repeats: bool = False) -> Code:
    """Writes distributions that fit (context, value) pairs, then the pairs; returns the Code."""
    clusters = list(clusters or [0] * contexts) + ([max(clusters or [0]) + 1] if copies else [])
    n = max(clusters) + 1
    splits = [split] * n
    if copies and only_repeats:
        splits[-1] = Split(0, 0, 0)
    plan = Code(clusters, splits, [PrefixCode([], 0)] * n, 15 if prefix else 8, copies, Split(4, 2, 0) if copies else None)
    tokens = tokens_of(values, plan)
    if copies and only_repeats:
        tokens = [(c, 1, 0, 0) if c == clusters[-1] else (c, t, k, x) for c, t, k, x in tokens]
    counts = [[0] * (1 + max((t for c, t, _, _ in tokens if c == k), default=0)) for k in range(n)]
    for c, t, _, _ in tokens:
        counts[c][t] += 1
    if not prefix and max(map(len, counts)) > 256:
        raise ValueError("tokens do not fit an alias code")
    if copies and only_repeats and len(counts[-1]) < 2:
        counts[-1] = [0, 1]
    plan.codes = [PrefixCode.of_counts(x) if prefix else AliasCode.of_counts(x, 8) for x in counts]
    plan.write_to(s)
    write_tokens(s, tokens, plan)
    return plan


def write_tokens(s: BitSink, tokens: list[tuple[int, int, int, int]], code: Code) -> None:
    if code.prefix:
        for c, t, n, bits in tokens:
            s.write(*code.codes[c].codes[t])
            s.write(n, bits)
        return
    places = []
    for c in code.codes:
        mine: dict = {}
        for at in range(TOTAL):
            symbol, k = c.place(at)
            mine[symbol, k] = at
        places.append(mine)
    state, low = FINAL_STATE, []
    for c, t, _, _ in reversed(tokens):  # what is decoded last is encoded first
        count = code.codes[c].counts[t]
        out = None
        if state >> 32 - TOTAL_BITS >= count:
            out, state = state & 0xFFFF, state >> 16
        state = (state // count << TOTAL_BITS) + places[c][t, state % count]
        low.append(out)
    s.write(32, state)
    for (_, _, n, bits), refill in zip(tokens, reversed(low)):
        if refill is not None:
            s.write(16, refill)
        s.write(n, bits)


def permutation_context(value: int) -> int:
    return min(7, ceil_log2(value + 1))


def from_lehmer(code: list[int], n: int) -> list[int]:
    """The permutation whose i-th entry is the code's i-th choice among what is left; a missing choice is the first."""
    left, out = list(range(n)), []
    for k in code:
        if k >= len(left):
            raise StreamError("a choice beyond what is left")
        out.append(left.pop(k))
    return out + left


def to_lehmer(order: list[int]) -> list[int]:
    left, out = sorted(order), []
    for v in order:
        out.append(left.index(v))
        left.pop(out[-1])
    while out and out[-1] == 0:
        out.pop()
    return out


def read_permutation(reader: Reader, size: int, skip: int = 0) -> list[int]:
    n, before, code = reader.read(permutation_context(size)), 0, []
    if n > size - skip:
        raise StreamError("a permutation is longer than its range")
    for _ in range(n):
        before = reader.read(permutation_context(before))
        code.append(before)
    return [*range(skip), *[skip + x for x in from_lehmer(code, size - skip)]]


def permutation_values(order: list[int], skip: int = 0) -> list[tuple[int, int]]:
    code = to_lehmer([x - skip for x in order[skip:]])
    return [(permutation_context(len(order)), len(code)), *[(permutation_context(p), c) for p, c in zip([0, *code], code)]]


def compose(first: list[int], then: list[int]) -> list[int]:
    return [first[i] for i in then]
