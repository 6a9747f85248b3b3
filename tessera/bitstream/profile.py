"""Colour profiles inside a stream: bytes under contexts of the two before them, which hold commands and data that rebuild the profile."""

from __future__ import annotations

import struct

from tessera.bitstream.bits import Bits, BitSink, StreamError
from tessera.bitstream.entropy import Code, Reader, encode

CONTEXTS, HEADER = 41, 128
# Tags and types that have a number.
TAGS = (b"rTRC", b"rXYZ", b"cprt", b"wtpt", b"bkpt", b"rXYZ", b"gXYZ", b"bXYZ", b"kXYZ", b"rTRC", b"gTRC", b"bTRC", b"kTRC", b"chad", b"desc", b"chrm", b"dmnd", b"dmdd", b"lumi")
TYPES = (b"XYZ ", b"desc", b"text", b"mluc", b"para", b"curv", b"sf32", b"gbd ")
POINTS = frozenset((b"rXYZ", b"gXYZ", b"bXYZ", b"kXYZ", b"wtpt", b"bkpt", b"lumi"))
MAKERS = (b"APPL", b"MSFT", b"SGI ", b"SUNW")
WHITE = bytes.fromhex("0000f6d6 00010000 0000d32d")


def _kinds() -> tuple[list[int], list[int]]:
    """Of every byte: its kind as the last one and as the one before it."""
    near, far = [], []
    for v in range(256):
        c = chr(v)
        word, number = v < 128 and c.isalpha(), v < 128 and (c.isdigit() or c in ".,")
        near.append(0 if word else 1 if number else 2 + v if v < 2 else 4 if v < 16 else 7 if v < 241 else 5 if v < 255 else 6)
        far.append(0 if word else 1 if number else 2 if v < 16 else 4 if v < 241 else 3)
    return near, far


NEAR, FAR = _kinds()


def context_at(coded: bytes | bytearray, k: int) -> int:
    """Of the k-th byte."""
    return 1 + NEAR[coded[k - 1]] + 8 * FAR[coded[k - 2]] if k > HEADER else 0


def expected_header(size: int, known: bytes) -> bytes:
    """What the header of a profile of a display is likely to be, as far as its bytes before an unknown one tell."""
    out = bytearray(HEADER)
    out[0:4] = struct.pack(">I", size)
    out[8] = 4
    out[12:24], out[36:40], out[68:80] = b"mntrRGB XYZ ", b"acsp", WHITE
    out[80:84] = known[4:8].ljust(4, b"\0")
    maker = known[40:42]
    for m in MAKERS:
        if maker[:1] == m[:1] and (m[:1] != b"S" or maker == m[:2]):
            out[41:44] = m[1:]
            if m[:1] == b"S":
                out[41] = 0
    return bytes(out)


class _Source:
    """Bytes in order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left:
            raise StreamError("a profile's data end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        out = 0
        for shift in range(0, 63, 7):
            v = self.byte()
            out |= (v & 127) << shift
            if v < 128:
                break
        return out


def interleaved(data: bytes, width: int) -> bytes:
    """Planes of the first bytes of all numbers, their second bytes, ... to numbers of `width` bytes; a last number may be shorter."""
    out, at = bytearray(len(data)), 0
    for k in range(width):
        n = len(out[k::width])
        out[k::width] = data[at : at + n]
        at += n
    return bytes(out)


def planes(data: bytes, width: int) -> bytes:
    return b"".join(data[k::width] for k in range(width))


def _predicted(out: bytearray, width: int, order: int, stride: int) -> int:
    """A number from those one, two and three strides before, by a polynomial of the order."""
    a, b, c = (int.from_bytes(out[len(out) - stride * k : len(out) - stride * k + width], "big") if k <= order + 1 else 0 for k in (1, 2, 3))
    return (a, 2 * a - b, 3 * (a - b) + c)[order]


def _tags(out: bytearray, commands: _Source, data: _Source, count: int, size: int) -> None:
    start, length = HEADER + 12 * count, 0
    while commands.left:
        command = commands.byte()
        number = command & 63
        if number == 0:
            return
        if number > 1 + len(TAGS):
            raise StreamError("a profile's tag")
        tag = data.take(4) if number == 1 else TAGS[number - 2]
        start = commands.number() if command & 64 else start + length
        length = commands.number() if command & 128 else 20 if tag in POINTS else length
        if start + length > size:
            raise StreamError("a tag goes beyond its profile")
        steps = {2: ((tag, 0), (b"gTRC", 0), (b"bTRC", 0)), 3: ((tag, 0), (b"gXYZ", 1), (b"bXYZ", 2))}.get(number, ((tag, 0),))
        for name, k in steps:
            out += name + struct.pack(">II", start + k * length & 0xFFFFFFFF, length)


def rebuilt(coded: bytes) -> bytes:
    """Commands and data to the profile. They must give exactly its announced size and be used up."""
    data = _Source(coded)
    size, n = data.number(), data.number()
    if size > 1 << 28 or size + 65536 < len(coded):
        raise StreamError("a profile's size")
    commands = _Source(data.take(n))
    first = data.take(min(size, HEADER))
    out = bytearray((a + b) % 256 for a, b in zip(first, expected_header(size, first)))
    if size > HEADER:
        count = commands.number()
        if count:
            if (size - HEADER) // 12 < count - 1:
                raise StreamError("more tags than a profile has room for")
            out += struct.pack(">I", count - 1)
            _tags(out, commands, data, count - 1, size)
        while commands.left:
            command = commands.byte()
            if command == 1:
                out += data.take(commands.number())
            elif command in (2, 3):
                out += interleaved(data.take(commands.number()), 2 * command - 2)
            elif command == 4:
                flags = commands.byte()
                width, order = (flags & 3) + 1, flags >> 2 & 3
                stride = commands.number() if flags & 16 else width
                if width == 3 or order == 3 or stride < width or 4 * stride >= len(out):
                    raise StreamError("a prediction in a profile")
                rest = interleaved(data.take(commands.number()), width)
                for at in range(0, len(rest), width):
                    p = (_predicted(out, width, order, stride) % (1 << 8 * width)).to_bytes(width, "big")
                    out += bytes((a + b) % 256 for a, b in zip(p, rest[at : at + width]))
            elif command == 10:
                out += b"XYZ \0\0\0\0" + data.take(12)
            elif 16 <= command < 16 + len(TYPES):
                out += TYPES[command - 16] + bytes(4)
            else:
                raise StreamError("a profile's command")
            if len(out) > size:
                raise StreamError("a profile longer than announced")
    if len(out) != size or data.left:
        raise StreamError("a profile of another size than announced")
    return bytes(out)


def read_profile(b: Bits) -> bytes:
    n = b.u64()
    if n > 1 << 20:
        raise StreamError("a profile is too large")
    code = Code.read_from(b, CONTEXTS)
    reader, out = Reader(code, b), bytearray()
    for k in range(n):
        v = reader.read(context_at(out, k))
        if v > 255:
            raise StreamError("a byte of a profile")
        out.append(v)
        if b.at > b.end:
            break
    reader.finish()
    return rebuilt(bytes(out))


# writing


def _number(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _apart(value: int, predicted: int) -> bytes:
    """Byte by byte, without carries."""
    return bytes((a - b) % 256 for a, b in zip(value.to_bytes(2, "big"), predicted.to_bytes(2, "big")))


def taken_apart(profile: bytes) -> bytes:
    """Commands and data that rebuild a profile: its tags one by one, points and types by number, curves by their second differences."""
    size = len(profile)
    expected = expected_header(size, profile)
    data = bytearray((a - b) % 256 for a, b in zip(profile, expected))
    commands, at = bytearray(), HEADER
    if size > HEADER:
        count = struct.unpack_from(">I", profile, HEADER)[0] if size >= HEADER + 4 else 1 << 30
        if HEADER + 4 + 12 * count > size or any(sum(struct.unpack_from(">II", profile, HEADER + 8 + 12 * k)) > size for k in range(count)):
            commands += _number(0)
        else:
            commands += _number(count + 1)
            start, length, at = HEADER + 12 * count, 0, HEADER + 4 + 12 * count
            for k in range(count):
                tag, here, n = struct.unpack_from(">4sII", profile, HEADER + 4 + 12 * k)
                known = TAGS.index(tag, 2) + 2 if tag in TAGS[2:] else 1
                follows, usual = here == start + length, n == (20 if tag in POINTS else length)
                commands.append(known | 64 * (not follows) | 128 * (not usual))
                data += tag if known == 1 else b""
                commands += (b"" if follows else _number(here)) + (b"" if usual else _number(n))
                start, length = here, n
            commands.append(0)
    while at < size:
        kind = profile[at : at + 4]
        if kind == b"XYZ " and profile[at + 4 : at + 8] == bytes(4) and at + 20 <= size:
            commands.append(10)
            data += profile[at + 8 : at + 20]
            at += 20
        elif kind in TYPES and profile[at + 4 : at + 8] == bytes(4):
            commands.append(16 + TYPES.index(kind))
            at += 8
            n = struct.unpack_from(">I", profile, at)[0] if kind == b"curv" and at + 4 <= size else 0
            if n > 8 and at + 4 + 2 * n <= size:
                commands += b"\x01" + _number(10) + b"\x04" + bytes([1 | 1 << 2]) + _number(2 * n - 6)
                data += profile[at : at + 10]
                values = [int.from_bytes(profile[at + 4 + 2 * k : at + 6 + 2 * k], "big") for k in range(n)]
                data += planes(b"".join(_apart(v, (2 * p - pp) % 65536) for v, p, pp in zip(values[3:], values[2:], values[1:])), 2)
                at += 4 + 2 * n
        else:
            ends = [p for p in (profile.find(t + bytes(4), at + 1) for t in TYPES) if p > 0]
            end = min(ends, default=size)
            commands += b"\x01" + _number(end - at)
            data += profile[at:end]
            at = end
    return _number(size) + _number(len(commands)) + bytes(commands) + bytes(data)


def write_profile(s: BitSink, profile: bytes, prefix: bool = True) -> None:
    coded = taken_apart(profile)
    s.u64(len(coded))
    encode(s, [(context_at(coded, k), v) for k, v in enumerate(coded)], CONTEXTS, prefix, clusters=[k % 8 for k in range(CONTEXTS)])
