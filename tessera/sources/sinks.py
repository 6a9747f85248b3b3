"""Sinks: planes as PNG, PPM and NPY bytes, one image a row; parquet is Spark's own."""

from __future__ import annotations

import io
import struct
import zlib
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_u8(v: np.ndarray) -> np.ndarray:
    return (np.clip(np.nan_to_num(v) * 255, 0, 255) + 0.5).astype(np.uint8)


def ppm(image: np.ndarray) -> bytes:
    """h x w (PGM) or h x w x 3 (PPM), 8 bits."""
    h, w = image.shape[:2]
    return f"{'P6' if image.ndim == 3 else 'P5'}\n{w} {h}\n255\n".encode() + to_u8(image).tobytes()


SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _rows(image: np.ndarray, bits: int) -> bytes:
    """Compressed rows without a filter; 16 bits come high byte first."""
    h = image.shape[0]
    v = to_u8(image) if bits == 8 else (np.clip(np.nan_to_num(image) * 65535, 0, 65535) + 0.5).astype(">u2")
    return zlib.compress(np.hstack([np.zeros((h, 1), np.uint8), v.reshape(h, -1).view(np.uint8)]).tobytes(), 6)


def _head(image: np.ndarray, bits: int, cicp: tuple | None, icc: bytes | None) -> bytes:
    """Signature and header; then what the colours mean: coding-independent code points, or a profile, or sRGB."""
    h, w = image.shape[:2]
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, {2: 0, 3: 2}[image.ndim] if image.ndim == 2 or image.shape[2] == 3 else 6, 0, 0, 0))
    if cicp:
        return out + chunk(b"cICP", bytes([*cicp, 0, 1]))
    return out + (chunk(b"iCCP", b"profile\0\0" + zlib.compress(icc)) if icc else chunk(b"sRGB", b"\0"))


def png(image: np.ndarray, bits: int = 8, cicp: tuple | None = None, icc: bytes | None = None) -> bytes:
    """h x w, or h x w x 3 or 4; 8 or 16 bits. cicp: (primaries, transfer function)."""
    return _head(image, bits, cicp, icc) + chunk(b"IDAT", _rows(image, bits)) + chunk(b"IEND", b"")


def apng(frames: list[np.ndarray], milliseconds: list[float], bits: int = 8, loops: int = 0, cicp: tuple | None = None, icc: bytes | None = None) -> bytes:
    """Whole frames of one size, each with its time; the first is also the still image."""
    h, w = frames[0].shape[:2]
    out, number = _head(frames[0], bits, cicp, icc) + chunk(b"acTL", struct.pack(">II", len(frames), loops)), 0
    for i, (image, ms) in enumerate(zip(frames, milliseconds)):
        out += chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, w, h, 0, 0, *apng_delay(ms), 0, 0))
        number += 1
        if i:
            out += chunk(b"fdAT", struct.pack(">I", number) + _rows(image, bits))
            number += 1
        else:
            out += chunk(b"IDAT", _rows(image, bits))
    return out + chunk(b"IEND", b"")


def npy(frames: np.ndarray) -> bytes:
    """Frames x h x w x c as little-endian floats in [0, 1]."""
    out = io.BytesIO()
    np.save(out, np.clip(frames, 0, 1).astype("<f4"))
    return out.getvalue()


def apng_delay(ms: float) -> tuple[int, int]:
    """Milliseconds as a reduced fraction of seconds."""
    n, d = int(ms), 1000
    g = gcd(n, d) or 1
    return n // g, d // g


ENCODERS = {"ppm": ppm, "png": png, "npy": lambda a: npy(a[None, :, :, None] if a.ndim == 2 else a[None])}


def encode_images(planes: DataFrame, form: str) -> DataFrame:
    """(img, y, v array) rows to (img, content): an image's rows meet in one task, which holds that image only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.stack([np.asarray(v, dtype=float) for v in pdf.sort_values("y")["v"]])
        return pd.DataFrame({"img": [pdf["img"].iloc[0]], "content": [ENCODERS[form](image)]})

    return planes.groupBy("img").applyInPandas(run, "img long, content binary")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.expr("cast(vec_id div 64 as bigint)").alias("img"), (F.col("vec_id") % 64).alias("y"), F.expr("transform(embedding, z -> cast(z + 0.5 as double))").alias("v"))


def _sink(form: str):
    def query(spark, sf_dir):
        return encode_images(_images(spark, sf_dir), form).select("img", F.length("content").alias("bytes"), F.sha2("content", 256).alias("digest"))

    return query


QUERIES = {"k1_png": _sink("png"), "k2_pnm": _sink("ppm"), "k3_npy": _sink("npy")}
