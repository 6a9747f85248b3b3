"""Byte-level BPE through sentencepiece: the model file is serialised directly from a vocabulary of ranks.

Each token's bytes are mapped to printable characters, one for each byte; the piece's score is its negative rank, so sentencepiece merges the
pair of lowest rank first, leftmost on ties, as byte-pair encoding does. Normalisation is the identity. Texts are cut into
pre-tokens first; a pre-token that is itself in the vocabulary is one token. Decoding maps ids back to bytes.

Defined results: null text counts as empty (no ids, the hashes of nothing). Repeated rows each get a row; other columns are neither
read nor returned. The vocabulary's path is a parameter; the driver reads it and ships the model, about 1 MB, to the executors.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Pieces whose ids a worker remembers (twice as many at most), and how long they may be.
CACHE, CACHE_LENGTH = 100_000, 64
BEFORE_SPACE = re.compile(r"\s ").search


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protobuf field: int and bool as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece i is token i; an unknown piece, which bytes never need, comes last."""
    letter = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letter[b] for b in token) or f"▁unused{rank}"
        out += _field(1, _field(1, piece.encode()) + _field(2, -float(rank)))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(tokens)
    # trainer_spec: model_type BPE, vocabulary size, no byte fallback, ids of <unk> and of pieces that are not there
    trainer = _field(3, 2) + _field(4, n + 1) + _field(35, 0) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # normalizer_spec: identity, without a dummy prefix, white-space removal or escaping
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class BpeCodec:
    """Encodes batches of texts.

    No pre-token of the pattern holds a space after another character, and the pattern never looks back. So a text may be cut before any
    single space that follows other than white space, and the pieces (a word with its marks) are pre-tokenised, encoded and remembered one
    by one. Texts where white space precedes a space are pre-tokenised as one piece.
    """

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import sentencepiece

        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens)}
        self.kind = np.dtype("<u2" if len(tokens) < 1 << 16 else "<u4")  # ids are remembered as bytes of this kind
        self.single = [i.to_bytes(self.kind.itemsize, "little") for i in range(len(tokens))]
        self.contents = pa.array(tokens, pa.large_binary())
        self.names = pa.array([b"%d," % i for i in range(len(tokens))], pa.large_binary())
        self.spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        # a byte that is in no text's UTF-8 sets pre-tokens apart, as a character that is in no piece
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())} | {"\xff": "\u2028"})
        self.known: dict = {}
        self.older: dict = {}

    def _pieces(self, text: str) -> list[str]:
        if BEFORE_SPACE(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _merge(self, cuts) -> dict[str, bytes]:
        """Pre-tokens to ids. A vocabulary entry is one token; the rest goes to sentencepiece many at a time."""
        out, rest, mapped, rank, single = {}, [], [], self.rank.get, self.single
        for cut in cuts:
            raw = cut.encode("utf-8", "surrogatepass")
            at = rank(raw)
            if at is not None:
                out[cut] = single[at]
            else:
                rest.append(cut)
                mapped.append(raw)
        width = self.kind.itemsize
        for at in range(0, len(rest), 256):
            found = np.array(self.spm.encode(b"\xff".join(mapped[at : at + 256]).decode("latin-1").translate(self.letters), out_type=int), dtype=np.int64)
            ends = (np.append(np.flatnonzero(found == len(self.tokens)), len(found)) * width).tolist()
            ids, start = found.astype(self.kind).tobytes(), 0
            for cut, end in zip(rest[at : at + 256], ends, strict=True):
                out[cut] = ids[start:end]
                start = end + width
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Pieces to ids."""
        parts = {p: self.cut(p) for p in pieces if not (p[1:].isalpha() and p[0] == " ")}
        whole = pieces.difference(parts)
        merged = self._merge(whole.union(*parts.values()))
        out = {p: merged[p] for p in whole}
        for p, cuts in parts.items():
            out[p] = merged[cuts[0]] if len(cuts) == 1 else b"".join(map(merged.__getitem__, cuts))
        return out

    def _encoded(self, texts: list) -> list[bytes]:
        """The ids of each text, as bytes."""
        cut = [self._pieces(t) if t else [] for t in texts]
        known, older = self.known, self.older
        new = set()
        for ps in cut:
            new.update(set(ps).difference(known))
        for p in new.intersection(older):
            known[p] = older[p]
        made = self._learn(new.difference(known))
        long = {p for p in made if len(p) > CACHE_LENGTH}
        known.update(made)
        out = [b"".join(map(known.__getitem__, ps)) for ps in cut]
        for p in long:
            del known[p]
        if len(known) > CACHE:
            self.known, self.older = {}, known
        return out

    def encode_batch(self, texts: list) -> list[np.ndarray]:
        return [np.frombuffer(x, self.kind).astype(np.int32) for x in self._encoded(texts)]

    @staticmethod
    def _joined(of: pa.Array, ids: list[np.ndarray]) -> list[memoryview]:
        """The ids' entries one behind the other, for each array of ids."""
        if not any(map(len, ids)):
            return [memoryview(b"")] * len(ids)
        found = of.take(pa.array(np.concatenate(ids)))
        at = np.frombuffer(found.buffers()[1], np.int64)[np.cumsum([0, *map(len, ids)])].tolist()
        data = memoryview(found.buffers()[2])
        return [data[lo:hi] for lo, hi in zip(at[:-1], at[1:])]

    def texts_of(self, ids: list[np.ndarray]) -> list[memoryview]:
        """Decimal ids joined by commas."""
        return [x[:-1] for x in self._joined(self.names, ids)]

    def decode_batch(self, ids: list[np.ndarray]) -> list[memoryview]:
        return self._joined(self.contents, ids)


def codec(path: str, pattern: str):
    """A picklable factory: the driver reads the vocabulary once, workers build the codec from shipped bytes."""
    tokens = read_ranks(path)
    model = serialise(tokens)
    return lambda: BpeCodec(tokens, model, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs to (doc_id, n_tokens, ids array<int>)."""
    make = codec(path, pattern)

    def start():
        bpe = make()
        return lambda cols: ((i, len(ids), ids) for i, ids in zip(cols["doc_id"], bpe.encode_batch(cols["text"])))

    return map_rows(docs.select("doc_id", "text"), start, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, content binary)."""
    tokens = read_ranks(path)

    def start():
        return lambda cols: ((i, b"".join(map(tokens.__getitem__, ids or []))) for i, ids in zip(cols["doc_id"], cols["ids"]))

    return map_rows(encoded.select("doc_id", "ids"), start, "doc_id long, content binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs to (doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded, in one pass without a shuffle."""
    make = codec(path, pattern)

    def start():
        bpe = make()

        def rows_of(cols):
            ids = bpe.encode_batch(cols["text"])
            for doc_id, x, written, content in zip(cols["doc_id"], ids, bpe.texts_of(ids), bpe.decode_batch(ids)):
                yield doc_id, len(x), hashlib.sha256(written).hexdigest(), hashlib.sha256(content).hexdigest()

        return rows_of

    return map_rows(docs.select("doc_id", "text"), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
