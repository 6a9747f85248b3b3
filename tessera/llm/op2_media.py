"""Media columns: texts stored losslessly as 8-bit samples of a WAV file, then sniffed, validated, typed and carved.

Aho-Corasick finds the magic bytes of all known formats in one pass; validators confirm structure and length of each hit; the confirmed
hit at offset 0 corrects the declared type, the others are embedded media that can be carved out.

Defined results: null text counts as empty; the payload is padded with bytes 0 to a positive multiple of 64, so empty text stores 64 zeros.
An empty table gives an empty result. Equal texts give equal values; repeated rows each get a row; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

RATE = 8000
# Magic bytes of the public formats, with the distance from the file's start.
MAGIC = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"ftyp", 4, "video/mp4"),
]


@dataclass(frozen=True)
class Hit:
    kind: str
    start: int
    length: int


def _png(b: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = int.from_bytes(b[i : i + 4], "big"), b[i + 4 : i + 8]
        if i + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return 0
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return 0


def _riff(b: bytes, at: int) -> tuple[str, int]:
    if at + 20 > len(b):
        return "", 0
    size, form = int.from_bytes(b[at + 4 : at + 8], "little") + 8, b[at + 8 : at + 12]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    if not kind or at + size > len(b) or size < 20:
        return "", 0
    i, names = at + 12, []
    while i + 8 <= at + size:
        names.append(b[i : i + 4])
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        i += 8 + n + (n & 1)
    if i != at + size or (kind == "audio/wav" and not {b"fmt ", b"data"} <= set(names)):
        return "", 0
    return kind, size


def _jpeg(b: bytes, at: int, places: Places) -> int:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind, n = b[i + 1], int.from_bytes(b[i + 2 : i + 4], "big")
        if n < 2 or not 0xC0 <= kind <= 0xFE:
            return 0
        i += 2 + n
        if kind == 0xDA:
            end = places.next(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else 0
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    i = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(i):
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, data, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    good = zero == 0 and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= data <= size
    return size if good and at + size <= len(b) else 0


def _crc(data: bytes, bits: int, poly: int) -> int:
    top, mask, value = 1 << (bits - 1), (1 << bits) - 1, 0
    for byte in data:
        value ^= byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ (poly if value & top else 0)) & mask
    return value


def _flac(b: bytes, at: int) -> int:
    """Up to the end of the last frame whose header and footer sums are right; the stream has no length of its own."""
    i, first, last = at + 4, True, False
    while not last:
        if i + 4 > len(b):
            return 0
        last, kind, n = b[i] >> 7, b[i] & 0x7F, int.from_bytes(b[i + 1 : i + 4], "big")
        if first != (kind == 0) or (first and n != 34) or kind == 127 or i + 4 + n > len(b):
            return 0
        i, first = i + 4 + n, False
    starts, known = [], i
    for m in re.compile(rb"\xff[\xf8\xf9]").finditer(b, i):
        j = m.start()
        if not starts and j != i:
            return 0
        more = {0x06: 1, 0x07: 2}.get(b[j + 2] >> 4, 0) + {0x0C: 1, 0x0D: 2, 0x0E: 2}.get(b[j + 2] & 15, 0) if j + 6 <= len(b) else 0
        coded = b[j + 4] if j + 6 <= len(b) else 0
        size = 5 + (0 if coded < 0x80 else max(0, 7 - (coded ^ 0xFF).bit_length() - 1)) + more
        if j + size < len(b) and _crc(b[j:j + size], 8, 0x07) == b[j + size]:
            starts.append(j)
    frame = starts[0] if starts else 0
    for end in [*starts[1:], len(b)] if starts else []:
        if _crc(b[frame : end - 2], 16, 0x8005) == int.from_bytes(b[end - 2 : end], "big"):
            known, frame = end, end
    return known - at if starts and known > starts[0] else 0


def _ogg(b: bytes, at: int) -> int:
    i = at
    while b[i : i + 5] == b"OggS\0" and i + 27 <= len(b):
        n = b[i + 26]
        end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if i + 27 + n > len(b) or end > len(b):
            return 0
        i = end
    return i - at


class Places:
    """Where a pattern lies in a blob, found once: the first place from an offset on, without a search for each hit."""

    def __init__(self, blob: bytes):
        self.blob, self.known = blob, {}

    def next(self, pattern: bytes, at: int) -> int:
        if pattern not in self.known:
            self.known[pattern] = [m.start() for m in re.finditer(re.escape(pattern), self.blob)]
        found = self.known[pattern]
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1


def _pdf(b: bytes, at: int, places: Places) -> int:
    if not b[at + 5 : at + 6].isdigit():
        return 0
    end, xref = places.next(b"%%EOF", at), places.next(b"startxref", at)
    return end + 5 - at if 0 <= xref < end else 0


def _mp4(b: bytes, at: int) -> int:
    i, seen = at, 0
    while i + 8 <= len(b):
        n, kind = int.from_bytes(b[i : i + 4], "big"), b[i + 4 : i + 8]
        if n < 8 or i + n > len(b) or not kind.isalnum():
            break
        i, seen = i + n, seen + 1
    return i - at if seen >= 2 else 0


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "video/mp4": _mp4}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, back, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), back, kind))
    found.make_automaton()
    return found


def sniff(blob: bytes, machine: ahocorasick.Automaton) -> list[Hit]:
    """All confirmed media in blob, by start; each with its validated length. Pages, boxes and the like inside a confirmed medium of
    their own kind are parts of it."""
    hits, places, upto = [], Places(blob), {}
    for end, (n, back, kind) in machine.iter(blob.decode("latin-1")):
        at = end + 1 - n - back
        if at < upto.get(kind, 0):
            continue
        if kind == "riff":
            found, length = _riff(blob, at)
        else:
            found, check = kind, VALIDATORS[kind]
            length = check(blob, at, places) if check in (_pdf, _jpeg) else check(blob, at)
        if length:
            hits.append(Hit(found, at, length))
            if kind != "riff":
                upto[kind] = at + length
    return sorted(hits, key=lambda h: (h.start, h.kind))


def correct_type(declared: str | None, hits: list[Hit]) -> str:
    """The confirmed type of the whole blob; what was declared if nothing confirmed starts it; octet-stream if neither is there."""
    return next((h.kind for h in hits if h.start == 0), declared or "application/octet-stream")


def carve(blob: bytes, hits: list[Hit]) -> list[tuple[str, bytes]]:
    """Embedded media: every confirmed hit but the whole."""
    return [(h.kind, blob[h.start : h.start + h.length]) for h in hits if h.start]


def to_wav(payload: bytes) -> bytes:
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def from_wav(blob: bytes) -> bytes:
    i = 12
    while i + 8 <= len(blob):
        n = int.from_bytes(blob[i + 4 : i + 8], "little")
        if blob[i : i + 4] == b"data":
            return blob[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64)


def _digest():
    machine = automaton()

    def rows_of(cols):
        for doc_id, n, blob, declared in zip(cols["doc_id"], cols["n_bytes"], cols["media"], cols["declared"]):
            hits = sniff(blob, machine)
            back = from_wav(blob)
            x = np.frombuffer(back, dtype=np.uint8)
            crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
            inner = "+".join(f"{h.kind}:{h.start}:{h.length}:{zlib.crc32(content):08x}" for h, (_, content) in zip([h for h in hits if h.start], carve(blob, hits)))
            feature = f"type={correct_type(declared, hits)};declared={declared};embedded={inner or '-'};rate={RATE};samples={len(x)};mean={x.mean():.4f};std={x.std():.4f};crossings={crossings}"
            yield doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature

    return rows_of


def media_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row of digests and features each: texts are stored, then the stored column, declared as text, is read; no shuffle."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(store(docs).withColumn("declared", F.lit("text/plain")), _digest, ddl)


def _store():
    def rows_of(cols):
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            n, payload = payload_of(text)
            yield doc_id, n, to_wav(payload)

    return rows_of


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, media): the stored form itself, a binary column, and the length of the text in it."""
    return map_rows(docs.select("doc_id", "text"), _store, "doc_id long, n_bytes long, media binary")


def _inspect():
    machine = automaton()

    def rows_of(cols):
        for key, blob, declared in zip(cols["doc_id"], cols["media"], cols["declared"]):
            hits = sniff(blob or b"", machine)
            yield key, correct_type(declared, hits), [{"kind": k, "content": c} for k, c in carve(blob or b"", hits)]

    return rows_of


def inspect(media: DataFrame) -> DataFrame:
    """(doc_id, media, declared) to (doc_id, corrected type, carved media). Null blobs count as empty."""
    return map_rows(media.select("doc_id", "media", "declared"), _inspect, "doc_id long, type string, embedded array<struct<kind: string, content: binary>>")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
