"""Bits, least significant first: a reader whose errors wait until the end, a writer, and the scalar codes of headers."""

from __future__ import annotations

import struct


class StreamError(ValueError):
    """The stream breaks a rule of the format."""


class Bits:
    """Reads bits; beyond the end zeros come, and check() tells. So a decoder asks once a section, not once a symbol."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 9], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out

    def skip(self, n: int) -> None:
        self.at += n

    def align(self) -> None:
        if self.read(-self.at % 8):
            raise StreamError("bits before a byte boundary are not zero")

    def split(self, n_bytes: int) -> Bits:
        """The next bytes as a reader of their own; this one goes on behind them."""
        if self.at % 8:
            raise StreamError("a part must begin at a byte")
        at = self.at >> 3
        self.at += 8 * n_bytes
        self.check()
        return Bits(self.data[at : at + n_bytes])

    @property
    def missing(self) -> int:
        """Bytes that reading has asked for beyond the end."""
        return max(0, -(-(self.at - self.end) // 8))

    def check(self) -> None:
        if self.at > self.end:
            raise EOFError(f"{self.missing} bytes are missing")

    # scalar codes; a distribution is (bits, offset), and 0 bits are a constant
    def u32(self, *choices) -> int:
        bits, offset = choices[self.read(2)]
        return offset + self.read(bits)

    def u64(self) -> int:
        kind = self.read(2)
        if kind < 2:
            return kind and 1 + self.read(4)
        if kind == 2:
            return 17 + self.read(8)
        out, shift = self.read(12), 12
        while self.read(1):
            if shift == 60:
                return out | self.read(4) << shift
            out |= self.read(8) << shift
            shift += 8
        return out

    def f16(self) -> float:
        raw = self.read(16)
        if raw >> 10 & 31 == 31:
            raise StreamError("a half-precision number is infinite or none")
        return struct.unpack("<e", raw.to_bytes(2, "little"))[0]

    def flag(self) -> bool:
        return bool(self.read(1))

    def enum(self) -> int:
        return self.u32((0, 0), (0, 1), (4, 2), (6, 18))

    def signed(self, *choices) -> int:
        return unpack_signed(self.u32(*choices))

    def string(self) -> str:
        n = self.u32((0, 0), (4, 0), (5, 16), (10, 48))
        return bytes(self.read(8) for _ in range(n)).decode("utf-8", "replace")

    def varint16(self) -> int:
        if not self.read(1):
            return 0
        n = self.read(4)
        return (1 << n) + self.read(n)

    def varint8(self) -> int:
        if not self.read(1):
            return 0
        n = self.read(3)
        return (1 << n) + self.read(n)


class BitSink:
    """Writes what Bits reads."""

    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def write(self, n: int, value: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 4096:
            whole = self.n // 8
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def align(self) -> None:
        self.n += -(self.n + 8 * len(self.done)) % 8

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) // 8, "little")

    def u32(self, value: int, *choices) -> None:
        for kind, (bits, offset) in enumerate(choices):
            if 0 <= value - offset < 1 << bits:
                self.write(2, kind)
                self.write(bits, value - offset)
                return
        raise ValueError(f"{value} is in no range")

    def u64(self, value: int) -> None:
        if value < 17:
            self.write(2, min(value, 1))
            self.write(4 * (value > 0), max(value - 1, 0))
        elif value < 273:
            self.write(2, 2)
            self.write(8, value - 17)
        else:
            self.write(2, 3)
            self.write(12, value & 4095)
            value, shift = value >> 12, 12
            while value:
                self.write(1, 1)
                n = 4 if shift == 60 else 8
                self.write(n, value & ((1 << n) - 1))
                value, shift = value >> n, shift + 8
            if shift <= 60:
                self.write(1, 0)

    def f16(self, value: float) -> None:
        self.write(16, int.from_bytes(struct.pack("<e", value), "little"))

    def enum(self, value: int) -> None:
        self.u32(value, (0, 0), (0, 1), (4, 2), (6, 18))

    def string(self, text: str) -> None:
        raw = text.encode()
        self.u32(len(raw), (0, 0), (4, 0), (5, 16), (10, 48))
        for b in raw:
            self.write(8, b)

    def _varint(self, value: int, head: int) -> None:
        self.write(1, min(value, 1))
        if value:
            n = value.bit_length() - 1
            self.write(head, n)
            self.write(n, value - (1 << n))

    def varint16(self, value: int) -> None:
        self._varint(value, 4)

    def varint8(self, value: int) -> None:
        self._varint(value, 3)


def unpack_signed(u: int) -> int:
    return -(u + 1 >> 1) if u & 1 else u >> 1


def pack_signed(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def ceil_log2(n: int) -> int:
    return (n - 1).bit_length()
