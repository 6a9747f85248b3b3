"""Colour profiles of an encoding: header, description, white, adaptation, code points, primaries and curve, as bytes."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.arrow import map_rows
from tessera.functions.primaries import COMMON, INTENTS, PRIMARIES, WHITE_POINTS, adapt_to_d50, rgb_to_xyz, xyz

# Parameters of parametric curves, the white of adapted profiles, and code points of primaries and transfer functions.
CURVES = {
    "SRG": (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045),
    "709": (1 / 0.45, 1 / 1.099, 0.099 / 1.099, 1 / 4.5, 0.081),
    "Lin": (1.0, 1.0, 0.0, 1.0, 0.0),
    "DCI": (2.6, 1.0, 0.0, 1.0, 0.0),
}
WHITE = (0.964203, 1.0, 0.824905)
CODE_PRIMARIES = {("D65", "SRG"): 1, ("D65", "202"): 9, ("D65", "DCI"): 12, ("DCI", "DCI"): 11}
CODE_TRANSFER = {"709": 1, "Lin": 8, "SRG": 13, "PeQ": 16, "DCI": 17, "HLG": 18}


def fixed(values) -> bytes:
    """Numbers with 16 bits behind the point, rounded away from zero."""
    v = np.asarray(values, dtype=np.float32).ravel()
    if not (np.abs(v) <= 32767.995).all():
        raise ValueError("a number of a profile is out of range")
    scaled = v.astype(float) * 65536
    return (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(">i4").tobytes()


def text(value: str) -> bytes:
    """One record of plain ASCII in English."""
    raw = value.encode("ascii").decode("ascii").encode("utf-16-be")
    return b"mluc" + bytes(4) + struct.pack(">II4sII", 1, 12, b"enUS", len(raw), 28) + raw


def points(value) -> bytes:
    return b"XYZ " + bytes(4) + fixed(value)


def curve(transfer: str | float) -> bytes:
    """A named transfer function, or a gamma of less than 1 that encodes."""
    if isinstance(transfer, float):
        return b"para" + bytes(8) + fixed([1 / transfer])
    if transfer not in CURVES:
        raise NotImplementedError(f"a profile's curve of {transfer}")
    return b"para" + bytes(4) + struct.pack(">HH", 3, 0) + fixed(CURVES[transfer])


def name_of(space: str, white: str, primaries: str | None, transfer: str | float, intent: str) -> str:
    t = f"g{transfer:.7f}" if isinstance(transfer, float) else transfer
    parts = (white, primaries, intent, t) if space == "RGB" else (white, intent, t)
    common = COMMON.get((white, primaries, t, intent)) if space == "RGB" else None
    return common or "_".join((space, *parts))


def profile(space: str, white: str, primaries: str | None, transfer: str | float, intent: str = "Rel") -> bytes:
    """space: RGB or Gra. Sizes in the table of tags leave padding out; the identifier is the digest without flags and intent."""
    at_white = WHITE_POINTS[white]
    grey = space == "Gra"
    tags = [(b"desc", text(name_of(space, white, primaries, transfer, intent))), (b"cprt", text("CC0")), (b"wtpt", points(xyz(*at_white) if grey else WHITE))]
    if not grey:
        adapt = adapt_to_d50(at_white)
        tags.append((b"chad", b"sf32" + bytes(4) + fixed(adapt)))
        code = CODE_PRIMARIES.get((white, primaries))
        if code and transfer in CODE_TRANSFER:
            tags.append((b"cicp", b"cicp" + bytes(4) + bytes([code, CODE_TRANSFER[transfer], 0, 1])))
        for name, column in zip((b"rXYZ", b"gXYZ", b"bXYZ"), (adapt @ rgb_to_xyz(PRIMARIES[primaries], at_white)).T):
            tags.append((name, points(column)))
    tags += [(n, curve(transfer)) for n in ((b"kTRC",) if grey else (b"rTRC", b"gTRC", b"bTRC"))]
    body, table, places = bytearray(), bytearray(struct.pack(">I", len(tags))), {}
    start = 128 + 4 + 12 * len(tags)
    for name, data in tags:
        shared = name[1:] == b"TRC"
        if not (shared and data in places):
            places[data] = len(body)
            body += data + bytes(-len(data) % 4)
        table += struct.pack(">4sII", name, start + places[data], len(data))
    head = bytearray(128)
    struct.pack_into(">I4sI4s4s4s6H4s4s", head, 0, start + len(body), b"jxl ", 0x04400000, b"mntr", b"GRAY" if grey else b"RGB ", b"XYZ ", 2019, 12, 1, 0, 0, 0, b"acsp", b"APPL")
    struct.pack_into(">III4s", head, 68, 0xF6D6, 0x10000, 0xD32D, b"jxl ")
    whole = bytearray(head + table + body)
    whole[84:100] = hashlib.md5(whole).digest()
    struct.pack_into(">I", whole, 64, INTENTS.index(intent))
    return bytes(whole)


def profiles(encodings: DataFrame) -> DataFrame:
    """(id, space, white, primaries, transfer, gamma, intent) to (id, icc): a column of profiles, to be stored as any bytes. A gamma that
    isn't null stands for the transfer function."""

    def rows_of(cols):
        for i, space, white, primaries, transfer, gamma, intent in zip(*(cols[c] for c in ("id", "space", "white", "primaries", "transfer", "gamma", "intent"))):
            yield i, profile(space, white, primaries, transfer if gamma is None else float(gamma), intent)

    return map_rows(encodings.select("id", "space", "white", "primaries", "transfer", "gamma", "intent"), rows_of, "id long, icc binary")


def f15_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encoding for each customer; sizes and digests of its profile."""
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.expr(by) % len(names) + 1).cast("int"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    c = c.select("id", pick(("RGB", "RGB", "Gra"), "id").alias("space"), pick(list(WHITE_POINTS), "id div 3").alias("white"), pick(list(PRIMARIES), "id div 9").alias("primaries"), pick(list(CURVES), "id div 27").alias("transfer"), F.expr("case when id % 5 = 0 then 1 / (1 + id % 3) end").alias("gamma"), pick(INTENTS, "id").alias("intent"))
    return profiles(c).select("id", F.length("icc").alias("n_bytes"), F.sha2("icc", 256).alias("sha256"))


QUERIES = {"f15_profiles": f15_profiles}
