"""Block transforms and coefficient operators: relational where a sum over a basis table says it, numpy on whole blocks otherwise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.relational import Operator


def basis(n: int) -> np.ndarray:
    """B[u, y] of the unnormalised cosine transform: B @ B.T = n * identity."""
    u, y = np.mgrid[0:n, 0:n]
    return np.where(u == 0, 1.0, math.sqrt(2)) * np.cos((y + 0.5) * u * math.pi / n)


def idct2d(block: np.ndarray) -> np.ndarray:
    """Coefficients of rows x columns to samples; layouts of at least as many rows as columns are stored transposed."""
    rows, cols = block.shape
    m = block if rows < cols else block.reshape(cols, rows).T
    return basis(rows).T @ m @ basis(cols)


def dct2d(samples: np.ndarray) -> np.ndarray:
    """The inverse of idct2d."""
    rows, cols = samples.shape
    m = basis(rows) @ samples @ basis(cols).T / (rows * cols)
    return m if rows < cols else np.ascontiguousarray(m.T).reshape(rows, cols)


def scales(n: int) -> np.ndarray:
    i = np.arange(n)
    return n * np.cos(i * math.pi / (16 * n)) * np.cos(i * math.pi / (8 * n)) * np.cos(i * math.pi / (4 * n))


def reinterpreting_dct(samples: np.ndarray) -> np.ndarray:
    """Low-frequency samples to the lowest coefficients of the larger block."""
    rows, cols = samples.shape
    m = basis(rows) @ samples @ basis(cols).T / np.outer(scales(rows), scales(cols))
    return m if rows < cols else m.T


def natural_order(cx: int, cy: int) -> np.ndarray:
    """Positions of a cx x cy block's coefficients (8 a side each) in the order they are coded: low frequencies, then zig-zag diagonals."""
    side, ratio = cx * 8, cx // cy
    low, rest = [(y, x) for y in range(cy) for x in range(cx)], []
    for diagonal in range(2 * side - 1):
        cells = [(y, diagonal - y) for y in range(side) if 0 <= diagonal - y < side]
        cells.sort(key=lambda c: c[1 - diagonal % 2])  # even diagonals by x, odd ones by y
        rest += [(y // ratio, x) for y, x in cells if y % ratio == 0 and not (x < cx and y // ratio < cy)]
    return np.array([y * side + x for y, x in low + rest])


def idct_blocks(tiles: DataFrame, rows: int, cols: int) -> DataFrame:
    """(id, coeff array) to (id, v array): one matrix product for all blocks of an Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(coeff: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(c, dtype=float) for c in coeff]) if len(coeff) else np.zeros((0, rows * cols))
        m = m.reshape(-1, rows, cols) if rows < cols else m.reshape(-1, cols, rows).transpose(0, 2, 1)
        return pd.Series(list((basis(rows).T @ m @ basis(cols)).reshape(len(coeff), -1)))

    return tiles.select("id", run("coeff").alias("v"))


_B8 = " union all ".join(f"select {u} u, {y} y, {float(basis(8)[u, y])!r}e0 b" for u in range(8) for y in range(8))
#: Two separable passes against the 64-row basis table, each a pre-aggregated sum.
_IDCT8 = (
    f"with b as ({_B8}), p as (select y @div 8 b_y, x @div 8 b_x, y % 8 v, x % 8 u, v c from {{plane}}),"
    " h as (select p.b_y, p.b_x, p.u, b.y x, sum(p.c*b.b) c from p join b on b.u = p.v group by p.b_y, p.b_x, p.u, b.y)"
    " select h.b_y*8+b.y y, h.b_x*8+h.x x, round(sum(h.c*b.b), 6) v from h join b on b.u = h.u group by h.b_y, h.b_x, h.x, b.y"
)
_BIAS = (1 - 0.05465007330715401, 1 - 0.07005449891748593, 1 - 0.049935103337343655, 0.145)  # fixed values: the format's default quantisation biases

OPERATORS = {
    "v2_lf_context": Operator("V2", "select k, l, ((case when c0 > 10 then 1 else 0 end + case when c0 > 30 then 1 else 0 end)*2 + case when c1 > 5 then 1 else 0 end)*3 + case when c2 > 2 then 1 else 0 end + case when c2 > 6 then 1 else 0 end ctx from {pix}", ("pix",)),
    "v5_block_contexts": Operator("V5", "with i as (select k, l, cast(((case c1 % 3 when 0 then 1 when 1 then 0 else 2 end*13 + c2)*2 + case when c0 > 25 then 1 else 0 end) % 15 as int) ctx, c0 nz from {pix}) select k, l, ctx, (case when nz < 8 then nz when nz < 64 then 4 + nz @div 2 else 36 end)*15 + ctx nonzero_ctx, 37*15 + 458*ctx density_offset from i", ("pix",)),
    "v7_accumulate_passes": Operator("V7", "select grp, len % 64 k, sum(cast(len as bigint) << cast(2 - pass % 3 as int)) coeff from {sections} group by grp, len % 64", ("sections",)),
    "v8_natural_order": Operator("V8", "select o.k, o.pos, count(p.c0) n from (" + " union all ".join(f"select {k} k, {int(p)} pos" for k, p in enumerate(natural_order(1, 1))) + ") o left join {pix} p on p.c0 = o.pos group by o.k, o.pos", ("pix",)),
    "v9_distance_bands": Operator("V9", "with d as (select k, l, least(sqrt(c1*c1+c2*c2*1e0), 9.999e0)*4e0/10e0 s from {pix}), b as (select *, cast(floor(s) as int) i from d), a as (select k, l, s, i, case i when 0 then 560e0 when 1 then 280e0 when 2 then 120e0 else 40e0 end a, case i when 0 then 280e0 when 1 then 120e0 when 2 then 40e0 else 10e0 end b from b) select k, l, round(a*pow(b/a, s-i), 6) w from a", ("pix",)),
    "v10_quantizer": Operator("V10", "select k, l, 65536e0/(c0+1) lf_quant, (c0+1)/65536e0*(c1+1) hf_scale from {pix}", ("pix",)),
    "v11_quant_bias": Operator("V11", "with p as (select k, l, c1-5 q from {pix}) select k, l, round(case when abs(q) < 2 then q*@b0 else q-@b3/q end, 6) v from p", ("pix",), {"b0": f"{_BIAS[0]!r}e0", "b3": f"{_BIAS[3]!r}e0"}),
    "v12_dequantise": Operator("V12", "with m as (select v % 64 kk, min(abs(v))+1 w from {ints} where v >= 0 group by v % 64), q as (select y @div 8 b_y, x @div 8 b_x, max(abs(v)) % 100 + 1 rq from {ints} group by 1, 2), t as (select y @div 64 ty, avg(v)/1e4 f from {ints} group by 1) select p.y, p.x, round(p.v*1e0/q.rq*m.w*(1e0+t.f), 6) v from {ints} p join m on m.kk = abs(p.v) % 64 join q on q.b_y = p.y @div 8 and q.b_x = p.x @div 8 join t on t.ty = p.y @div 64", ("ints",)),
    "v15_idct8": Operator("V15", _IDCT8, ("plane",)),
}


def _embedding_tiles(spark: SparkSession, sf_dir: str, rows: int, cols: int) -> DataFrame:
    """(id, coeff): runs of embeddings as blocks; what the last one lacks is 0."""
    n = rows * cols // 64
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("id", F.expr(f"vec_id div {n}"))
    tiles = e.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("s")).withColumn("c", F.expr("flatten(transform(s, r -> r.embedding))"))
    return tiles.select("id", F.concat(F.col("c").cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(rows * cols) - F.size("c"))).alias("coeff"))


def _idct_query(rows: int, cols: int):
    return lambda spark, sf_dir: idct_blocks(_embedding_tiles(spark, sf_dir, rows, cols), rows, cols).select("id", F.posexplode("v").alias("k", "v")).select("id", "k", F.round("v", 6).alias("v"))


def _idct_sql(rows: int, cols: int) -> str:
    """The definition, one direction after the other; blocks of at least as many rows as columns are stored transposed."""
    n = rows * cols // 64
    u, v = ("k // %d" % cols, "k %% %d" % cols) if rows < cols else ("k %% %d" % rows, "k // %d" % rows)
    wave = "case when {0} = 0 then 1e0 else sqrt(2e0)*cos(({1}+0.5e0)*{0}*pi()/{2}e0) end"
    return f"""with p as (select vec_id//{n} id, vec_id % {n} * 64 + t.x k, embedding[t.x+1]::double c from embeddings, range(0,64) t(x)), q as (select id, {u} u, {v} v, c from p), ids as (select distinct id from p),
h as (select id, u, x.x, sum(c*{wave.format('v', 'x.x', cols)}) c from q, range(0,{cols}) x(x) group by 1, 2, 3),
s as (select id, y.y, x, sum(c*{wave.format('u', 'y.y', rows)}) v from h, range(0,{rows}) y(y) group by 1, 2, 3)
select ids.id, a.k::int k, round(coalesce(s.v, 0e0), 6) + 0e0 v from ids cross join range(0,{rows * cols}) a(k) left join s on s.id = ids.id and s.y*{cols}+s.x = a.k"""


# special blocks of 8x8

#: Means of four quarters from the sums and differences that are coded.
MEANS = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, 1, -1], [1, -1, -1, 1]], dtype=float)


def _quarters(m: np.ndarray) -> np.ndarray:
    """Blocks to [n, quarter row, quarter column, 4, 4]: coefficients of a quarter lie two apart, their means come from the first four."""
    q = m.reshape(-1, 4, 2, 4, 2).transpose(0, 2, 4, 1, 3).copy()
    q[:, :, :, 0, 0] = (q[:, :, :, 0, 0].reshape(-1, 4) @ MEANS.T).reshape(-1, 2, 2)
    return q


def _joined(q: np.ndarray) -> np.ndarray:
    return q.transpose(0, 1, 3, 2, 4).reshape(-1, 8, 8)


def identity_blocks(m: np.ndarray) -> np.ndarray:
    """Quarters of plain differences to their sample at (1, 1), which their mean gives; the coefficient there belongs to the corner."""
    q = _quarters(m)
    mean = q[:, :, :, 0, 0].copy()
    q[:, :, :, 0, 0] = 0
    centre = mean - q.sum(axis=(3, 4)) / 16
    q[:, :, :, 0, 0] = q[:, :, :, 1, 1]
    q[:, :, :, 1, 1] = 0
    return _joined(q + centre[..., None, None])


def haar_blocks(m: np.ndarray) -> np.ndarray:
    """Sums and differences of pairs a side, from the top 2x2 to the whole block."""
    m = m.copy()
    for n in (1, 2, 4):
        a, b, c, d = m[:, :n, :n], m[:, :n, n : 2 * n], m[:, n : 2 * n, :n], m[:, n : 2 * n, n : 2 * n]
        out = np.stack([np.stack([a + b + c + d, a + b - c - d], -1), np.stack([a - b + c - d, a - b - c + d], -1)], -2)
        m[:, : 2 * n, : 2 * n] = out.transpose(0, 1, 3, 2, 4).reshape(-1, 2 * n, 2 * n)
    return m


def quarter_blocks(m: np.ndarray) -> np.ndarray:
    """Four 4x4 cosine transforms, which are stored transposed."""
    return _joined(basis(4).T @ _quarters(m).swapaxes(3, 4) @ basis(4))


def _halves(m: np.ndarray) -> np.ndarray:
    """Blocks to [n, half, 4, 8]: rows two apart, the means from the first two."""
    h = m.reshape(-1, 4, 2, 8).transpose(0, 2, 1, 3).copy()
    a, b = h[:, 0, 0, 0].copy(), h[:, 1, 0, 0].copy()
    h[:, 0, 0, 0], h[:, 1, 0, 0] = a + b, a - b
    return h


def wide_halves(m: np.ndarray) -> np.ndarray:
    """Two 4x8 cosine transforms, one above the other."""
    return (basis(4).T @ _halves(m) @ basis(8)).reshape(-1, 8, 8)


def tall_halves(m: np.ndarray) -> np.ndarray:
    """Two 8x4 cosine transforms side by side."""
    return (basis(8).T @ _halves(m).swapaxes(2, 3) @ basis(4)).transpose(0, 2, 1, 3).reshape(-1, 8, 8)


def plain_blocks(rows: int, cols: int):
    return lambda m: basis(rows).T @ (m.reshape(-1, rows, cols) if rows < cols else m.reshape(-1, cols, rows).swapaxes(1, 2)) @ basis(cols)


# The share of the corner sample in the corner transform's first wave, and the waves of the format whose first sample that is not 0 is negative.
CORNER_SHARE, FALLING = 0.876902929799142, (3, 4, 5, 6, 7, 11, 12, 13, 14)


def corner_waves() -> tuple[np.ndarray, np.ndarray]:
    """Waves [coefficient, y * 4 + x] of the corner transform, and their frequencies [y, x].

    They are the eigenvectors of the Laplacian (twice the links) of a 4x4 grid whose three samples at the corner are cut off, by rising
    eigenvalue along the diagonals, even ones by y, odd ones by x. The constant, and what tells the cut samples from each other and from
    the rest, have no frequency: those four waves are at the first four places."""
    at = [(y, x) for y in range(4) for x in range(4)]
    links = np.array([[2.0 * (abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 and min(sum(a), sum(b)) > 1) for b in at] for a in at])
    values, vectors = np.linalg.eigh(np.diag(links.sum(1)) - links)
    waves, frequency = np.zeros((16, 16)), np.zeros((4, 4))
    places = [4 * y + x for y, x in sorted(at, key=lambda p: (sum(p), p[sum(p) % 2])) if max(y, x) > 1]
    waves[places], frequency[np.divmod(places, 4)] = vectors.T[4:], values[4:]
    single = np.zeros(16)
    single[0] = 1
    pair = np.where([y + x == 1 for y, x in at], 1.0, 0) - 2 / 15 * (1 - single)
    single, pair = (single - 1 / 16) / math.sqrt(15 / 16), pair / np.linalg.norm(pair)
    near = CORNER_SHARE / math.sqrt(15 / 16)
    far = math.sqrt(1 - near * near)
    waves[0], waves[1], waves[5] = 0.25, near * single + far * pair, near * pair - far * single
    waves[4, [1, 4]] = math.sqrt(0.5), -math.sqrt(0.5)
    for k, w in enumerate(waves):
        first = w[np.flatnonzero(abs(w) > 1e-9)[0]]
        w *= -1 if (first < 0) != (k in FALLING) else 1
    return waves, frequency


CORNER, CORNER_FREQUENCY = corner_waves()


def corner_blocks(kind: int):
    """A 4x4 corner by its own waves, a 4x4 cosine transform beside it and a 4x8 one along the other half. kind: 1 for right, 2 for bottom."""
    right, down = kind % 2, kind // 2

    def run(m: np.ndarray) -> np.ndarray:
        a, b, c = m[:, 0, 0], m[:, 0, 1], m[:, 1, 0]
        corner, beside, along = m[:, ::2, ::2].copy(), m[:, ::2, 1::2].copy(), m[:, 1::2].copy()
        corner[:, 0, 0], beside[:, 0, 0], along[:, 0, 0] = 4 * (a + b + c), a - b + c, a - c
        corner = (corner.reshape(-1, 16) @ CORNER).reshape(-1, 4, 4)
        corner = np.flip(corner, [axis for axis, on in ((1, down), (2, right)) if on])
        beside = basis(4).T @ beside.swapaxes(1, 2) @ basis(4)
        half = np.concatenate([beside, corner] if right else [corner, beside], axis=2)
        along = basis(4).T @ along @ basis(8)
        return np.concatenate([along, half] if down else [half, along], axis=1)

    return run


#: Transforms by name.
KINDS = {"identity": identity_blocks, "dct2x2": haar_blocks, "dct4x4": quarter_blocks, "dct4x8": wide_halves, "dct8x4": tall_halves} | {f"corner{k}": corner_blocks(k) for k in range(4)} | {
    f"dct{r}x{c}": plain_blocks(r, c) for r, c in ((8, 8), (16, 16), (32, 32), (16, 8), (8, 16), (32, 8), (8, 32), (32, 16), (16, 32), (64, 64), (64, 32), (32, 64), (128, 128), (128, 64), (64, 128), (256, 256), (256, 128), (128, 256))
}


def size_of(kind: str) -> tuple[int, int]:
    """Rows and columns of samples; every special kind is 8x8."""
    rows, cols = map(int, kind[3:].split("x")) if kind.startswith("dct") else (8, 8)
    return max(rows, 8), max(cols, 8)


def blocks_to_plane(blocks: DataFrame) -> DataFrame:
    """(block_y, block_x, kind, coeff array, lf array) to the plane (y, x, v): the lowest coefficients of a block come from the samples of
    the low-frequency image that it covers (row by row), then its transform. block_y and block_x count blocks of 8. In a subsampled
    channel only blocks at its own places may be given; rows without coefficients give no samples."""

    @F.pandas_udf("array<double>")
    def run(kind: pd.Series, coeff: pd.Series, lf: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(kind), dtype=object)
        for k, at in kind.groupby(kind).groups.items():
            at = [i for i in at if coeff[i] is not None]
            if not at:
                continue
            rows, cols = size_of(k)
            m = np.stack([np.asarray(coeff[i], dtype=float) for i in at]).reshape(len(at), min(rows, cols), max(rows, cols))
            for one, i in zip(m, at):
                low = reinterpreting_dct(np.asarray(lf[i], dtype=float).reshape(rows // 8, cols // 8))
                one[: low.shape[0], : low.shape[1]] = low
            for i, v in zip(at, KINDS[k](m).reshape(len(at), -1)):
                out[i] = v
        return out

    wide = F.create_map(*[F.lit(x) for k in KINDS for x in (k, size_of(k)[1])])[F.col("kind")]
    cells = blocks.select("block_y", "block_x", wide.alias("w"), F.posexplode(run("kind", "coeff", "lf")).alias("k", "v"))
    return cells.selectExpr("block_y * 8 + k div w y", "block_x * 8 + k % w x", "v")


def inverse_blocks(tiles: DataFrame) -> DataFrame:
    """(id, kind, coeff array) to (id, kind, v array): the transform that each block names, in batches of a kind."""

    @F.pandas_udf("array<double>")
    def run(kind: pd.Series, coeff: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(kind), dtype=object)
        for k, at in kind.groupby(kind).groups.items():
            m = np.stack([np.asarray(coeff[i], dtype=float) for i in at])
            done = KINDS[k](m.reshape(-1, 8, 8) if m.shape[1] == 64 else m).reshape(len(at), -1)
            for i, v in zip(at, done):
                out[i] = v
        return out

    return tiles.select("id", "kind", run("kind", "coeff").alias("v"))


SMALL = ["identity", "dct2x2", "dct4x4", "dct4x8", "dct8x4", "dct8x8", "corner0", "corner1", "corner2", "corner3"]


def v14_block_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8x8 block of the kind that its number names."""
    kind = F.element_at(F.array(*map(F.lit, SMALL)), (F.col("vec_id") % len(SMALL) + 1).cast("int"))
    tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), kind.alias("kind"), F.col("embedding").alias("coeff"))
    return inverse_blocks(tiles).select("id", "kind", F.posexplode("v").alias("k", "v")).select("id", "kind", "k", F.round("v", 6).alias("v"))


def v19_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of embeddings as 8x16 blocks, one below the other; the means of their two squares are the low-frequency samples."""
    tiles = _embedding_tiles(spark, sf_dir, 8, 16)
    low = F.expr("array(coeff[0] + coeff[1], coeff[0] - coeff[1])")
    blocks = tiles.select(F.col("id").alias("block_y"), F.lit(0).alias("block_x"), F.lit("dct8x16").alias("kind"), "coeff", low.alias("lf"))
    return blocks_to_plane(blocks).selectExpr("cast(y as long) y", "cast(x as int) x", "round(v, 6) v")


_SIZES = [(16, 16), (8, 16), (16, 8), (32, 16), (32, 32), (64, 64), (64, 128)]
QUERIES = {"v15_idct16_blocks": _idct_query(16, 16), "v14_block_transforms": v14_block_transforms, "v19_assembly": v19_assembly} | {f"v15_idct_{r}x{c}": _idct_query(r, c) for r, c in _SIZES[1:]}
# the low-frequency samples c0 + c1 and c0 - c1 give the first coefficient c0 back, and the second one as 2 c1 by the format's scale
_V19 = _idct_sql(8, 16).replace("embedding[t.x+1]::double c from", "embedding[t.x+1]::double * case when vec_id % 2 = 0 and t.x = 1 then 1e0/(cos(pi()/32)*cos(pi()/16)*cos(pi()/8)) else 1e0 end c from")
ORACLE_SQL = {"v19_assembly": f"select id*8 + k//16 y, (k % 16)::int x, v from ({_V19})", "v15_idct16_blocks": _idct_sql(16, 16)} | {f"v15_idct_{r}x{c}": _idct_sql(r, c) for r, c in _SIZES[1:]}
