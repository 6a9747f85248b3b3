"""Noise planes and spline geometry: numpy over whole groups and whole curves, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.arrow import map_rows
from tessera.sources import views

_U = np.uint64
LANES = 8


def split_mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def seeds(first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """States of the eight generators of a group: chains of mixed numbers from two 64-bit seeds."""
    chains = []
    for seed in (first, second):
        z, out = np.array([(seed + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)], dtype=np.uint64), []
        for _ in range(LANES):
            z = split_mix(z)
            out.append(z)
        chains.append(np.concatenate(out))
    return chains[0], chains[1]


def steps(s0: np.ndarray, s1: np.ndarray, n: int) -> np.ndarray:
    """n rounds of the xorshift generators side by side: n x 8 numbers of 64 bits. The states move on in place."""
    out = np.empty((n, LANES), dtype=np.uint64)
    for i in range(n):
        out[i] = s0 + s1
        x = s0 ^ (s0 << _U(23))
        s0[:], s1[:] = s1, x ^ s1 ^ (x >> _U(18)) ^ (s1 >> _U(5))
    return out


def group_noise(frame: tuple[int, int], x0: int, y0: int, w: int, h: int) -> np.ndarray:
    """Three planes of numbers from 1 to 2: the top 23 bits of each half as a float's fraction, low halves first. A row ends its round."""
    s0, s1 = seeds((frame[0] << 32) + frame[1], (x0 << 32) + y0)
    rounds = -(-w // (2 * LANES))
    raw = steps(s0, s1, 3 * h * rounds).reshape(3, h, -1)
    halves = np.stack([raw & _U(0xFFFFFFFF), raw >> _U(32)], axis=-1).reshape(3, h, -1)[:, :, :w]
    return 1.0 + (halves >> _U(9)).astype(np.float64) / (1 << 23)


def noise(groups: DataFrame) -> DataFrame:
    """(frame, hidden, x0, y0, w, h) to (frame, c, y, x, v): a group's seed is its place, so groups are independent."""

    def rows_of(cols):
        for f, g, x0, y0, w, h in zip(*[cols[c] for c in ("frame", "hidden", "x0", "y0", "w", "h")]):
            for c, plane in enumerate(group_noise((f, g), x0, y0, w, h)):
                for y, row in enumerate(plane):
                    yield f, c, y0 + y, x0, row.tolist()

    out = map_rows(groups, rows_of, "frame int, c int, y int, x0 int, row array<double>", 4)
    return out.select("frame", "c", "y", F.posexplode("row").alias("i", "v"), "x0").select("frame", "c", "y", (F.col("x0") + F.col("i")).alias("x"), "v")


def p18_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of a small group for each label's frame."""
    f = views.read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return noise(f.select(F.col("label").cast("int").alias("frame"), F.lit(0).alias("hidden"), F.lit(256).alias("x0"), F.lit(0).alias("y0"), (20 + F.col("n") % 30).cast("int").alias("w"), F.lit(12).alias("h")))


# splines

# The format's weights of the dequantised colours and sigma, and the rendering distance.
WEIGHTS = (0.0042, 0.075, 0.07, 0.3333)
STEP = 1.0
POINTS = 16


def dequantised(start: tuple, deltas: list, dct: list, adjustment: int, y_to_x: float = 0.0, y_to_b: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Control points from second differences, and 4 x 32 coefficients of the three colours and sigma."""
    points = np.cumsum(np.vstack([np.round(start), np.cumsum(np.array(deltas, dtype=np.int64).reshape(-1, 2), axis=0)]), axis=0).astype(float)
    scale = 1 / (1 + adjustment / 8) if adjustment >= 0 else 1 - adjustment / 8
    out = np.array(dct, dtype=float) * np.array(WEIGHTS)[:, None] * scale
    out[:, 0] *= math.sqrt(0.5)
    out[0] += y_to_x * out[1]
    out[2] += y_to_b * out[1]
    return points, out


def curve(points: np.ndarray) -> np.ndarray:
    """Sixteen points of a centripetal Catmull-Rom curve for each control point but the last, and that one. Neighbours must differ. Curves of
    as many control points may be stacked along leading axes."""
    if points.shape[-2] < 2:
        return points
    ends = np.concatenate([2 * points[..., :1, :] - points[..., 1:2, :], points, 2 * points[..., -1:, :] - points[..., -2:-1, :]], axis=-2)
    apart = np.diff(ends, axis=-2)
    knots = np.sqrt(np.hypot(apart[..., 0], apart[..., 1]))  # parameter lengths of the pieces
    out = []
    for i in range(1, ends.shape[-2] - 2):
        p = [ends[..., k : k + 1, :] for k in range(i - 1, i + 3)]
        t = np.concatenate([np.zeros((*knots.shape[:-1], 1)), np.cumsum(knots[..., i - 1 : i + 2], axis=-1)], axis=-1)
        t = [t[..., k, None, None] for k in range(4)]
        u = t[1] + (np.arange(POINTS) / POINTS)[:, None] * (t[2] - t[1])

        def between(a, b, lo, hi, u=u):
            return a + (b - a) * ((u - lo) / (hi - lo))

        a = [between(p[k], p[k + 1], t[k], t[k + 1]) for k in range(3)]
        b = [between(a[k], a[k + 1], t[k], t[k + 2]) for k in range(2)]
        piece = between(b[0], b[1], t[1], t[2])
        piece[..., :1, :] = p[1]
        out.append(piece)
    return np.concatenate([*out, points[..., -1:, :]], axis=-2)


def evenly(points: np.ndarray, step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Points a step apart along straight pieces, then the last point; and how far along each has come since the one before."""
    if not len(points):
        return points, np.zeros(0)
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))]) if len(points) > 1 else np.zeros(1)
    at = np.arange(0.0, along[-1], step) if along[-1] > 0 else np.zeros(1)
    out = np.stack([np.interp(at, along, points[:, k]) for k in range(2)], axis=1)
    return np.vstack([out, points[-1:]]), np.append(np.full(len(at), step), along[-1] - at[-1])


def continuous(coefficients: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Values of a 32-point cosine series at positions from 0 to 31."""
    k = np.arange(32)
    return math.sqrt(2) * coefficients @ np.cos(np.outer(k, t + 0.5) * math.pi / 32)


def segments(start: tuple, deltas: list, dct: list, adjustment: int, y_to_x: float = 0.0, y_to_b: float = 1.0) -> np.ndarray:
    """(x, y, three colours, sigma, intensity) of each point to draw along a quantised spline."""
    control, series = dequantised(start, deltas, dct, adjustment, y_to_x, y_to_b)
    return drawn(curve(control), series)


def drawn(points: np.ndarray, series: np.ndarray) -> np.ndarray:
    """segments() of a curve and the coefficients along it."""
    points, gone = evenly(points)
    length = (len(points) - 2) * STEP + gone[-1]
    if length <= 0:
        return np.zeros((0, 7))
    t = 31 * np.minimum(1.0, np.arange(len(points)) * STEP / length)
    return np.column_stack([points, continuous(series, t).T, gone])


def round6(x: np.ndarray) -> np.ndarray:
    """Six places, as Python rounds: what the product brings near a half goes through round()."""
    y = x * 1e6
    out = np.rint(y) / 1e6
    near = np.abs(np.abs(y - np.floor(y)) - 0.5) < 1e-4
    out[near] = [round(v, 6) for v in x[near].tolist()]
    return out


#: Splines of a batch, and of a task at least.
BATCH, TASK = 256, 5000


def p17_spline_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spline for each customer, whose start and bends follow from the key: the points to draw. Splines of as many bends are curved together."""
    ddl = "id long, n int, x double, y double, c0 double, c1 double, c2 double, sigma double, intensity double"

    def splines(ids):
        """(place among ids, points to draw) of all splines."""
        for more in range(3):
            at = np.flatnonzero(ids % 3 == more)
            i, k = ids[at][:, None], np.arange(1, 4 + more)
            deltas = np.stack([(i * k) % 23 + 1, (i + k) % 19 - 9], axis=-1)
            start = np.stack([i % 90, i % 70], axis=-1)
            control = np.cumsum(np.concatenate([start, np.cumsum(deltas, axis=1)], axis=1), axis=1).astype(float)
            dct = (i[:, :, None] * np.arange(3, 7)[:, None] * np.arange(1, 33)) % 41 - 20
            for j, points, n, c in zip(at.tolist(), curve(control) if len(at) else [], ids[at].tolist(), dct):
                yield j, drawn(points, dequantised((0, 0), [], c, n % 5 - 2)[1])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                ids = batch.column(0).slice(lo, BATCH).to_numpy(zero_copy_only=False).astype(np.int64)
                found = [x for _, x in sorted(splines(ids), key=lambda x: x[0])]
                size = np.array([len(x) for x in found])
                n = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                columns = [np.repeat(ids, size), n.astype(np.int32), *round6(np.concatenate(found).T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=ddl.replace(",", "").split()[::2])

    keys = views.read(spark, sf_dir, "customer").select("c_custkey")
    # a key makes over a hundred rows, so files are no measure of the tasks
    return keys.repartition(min(4 * spark.sparkContext.defaultParallelism, 1 + keys.count() // TASK)).mapInArrow(run, ddl)


QUERIES = {"p18_noise": p18_noise, "p17_spline_geometry": p17_spline_geometry}
