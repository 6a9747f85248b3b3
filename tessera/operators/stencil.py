"""Neighbourhood operators over (y, x, v): window functions along rows and columns, borders mirrored with the edge repeated.

A window by y keeps a row together. Columns are cut into blocks of rows that share `reach` rows with their neighbours, so a window along y
holds at most a block, and tasks grow in number with the plane's height. A stencil costs one shuffle a direction."""

from __future__ import annotations

import numpy as np

from tessera.relational import Operator

#: Rows of a block of a column.
BLOCK = 256


def shifted(columns: list[str], reach: int, along: str, across: str, source: str) -> str:
    """Each column c with neighbours c_l2, c_l1, c_r1, ... along x or c_u1, c_d1, ... along y; beyond the border index -1-k mirrors to k."""
    out = []
    for c in columns:
        for k in range(1, reach + 1):
            for sign, fn, pos in (("lu"[along == "y"], "lag", along), ("rd"[along == "y"], "lead", f"(n_{along}-1-{along})")):
                # lag k mirrors to position k-1-pos, which lies (k-1-2*pos) away in the other direction
                flip = "lead" if fn == "lag" else "lag"
                mirrored = " ".join(f"when {pos} = {q} then {c if (d := k - 1 - 2 * q) == 0 else f'{flip if d > 0 else fn}({c},{abs(d)}) over w'}" for q in range(k))
                out.append(f"case {mirrored} else {fn}({c},{k}) over w end {c}_{sign}{k}")
    return f"select s.*, {', '.join(out)} from {source} s window w as (partition by {across} order by {along})"


def _sized(source: str) -> str:
    return f"select s.*, count(*) over (partition by y) n_x, n_y from {source} s cross join (select max(y)+1 n_y from {source}) size"


def haloed(source: str, reach: int) -> str:
    """Rows with the block that they belong to, and again with a neighbouring block that reaches them."""
    near = f"d = 0 or (d = -1 and y >= {BLOCK} and y % {BLOCK} < {reach}) or (d = 1 and y % {BLOCK} >= {BLOCK - reach})"
    return f"select s.*, cast(y @div {BLOCK} + d as int) blk from {source} s cross join (select -1 d union all select 0 union all select 1) near where {near}"


def down(columns: list[str], reach: int, source: str, end: str) -> str:
    """CTEs that end in `end`: the rows of the source with neighbours along y."""
    return f"{end}_b as ({haloed(source, reach)}), {end}_s as ({shifted(columns, reach, 'y', 'x, blk', f'{end}_b')}), {end} as (select * from {end}_s where blk = y @div {BLOCK})"


def grid(columns: list[str], reach: int, source: str) -> str:
    """CTEs ending in g: every column with its (2*reach+1)^2 neighbourhood, named c[_l|_r k][_u|_d k]."""
    sides = [""] + [f"_{s}{k}" for k in range(1, reach + 1) for s in "lr"]
    wide = [c + s for c in columns for s in sides]
    return f"with z as ({_sized(source)}), h as ({shifted(columns, reach, 'x', 'y', 'z')}), {down(wide, reach, 'h', 'g')}"


def name(c: str, dx: int, dy: int) -> str:
    side = lambda d, names: f"_{names[d > 0]}{abs(d)}" if d else ""
    return c + side(dx, "lr") + side(dy, "ud")


def weighted(c: str, weights: dict) -> str:
    return "(" + "+".join(f"({w:.17f}e0)*{name(c, dx, dy)}" for (dx, dy), w in weights.items()) + ")"


# The format's default weights of the 3x3 smoothing filter for edges and corners.
W1, W2 = 0.115169525, 0.061248592


def gaborish_weights(w1: float, w2: float) -> dict:
    total = 1 + 4 * w1 + 4 * w2
    return {(dx, dy): (1, w1, w2)[abs(dx) + abs(dy)] / total for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


_BOX = {(dx, dy): 1 for dy in range(-2, 3) for dx in range(-2, 3)}

# The format's default 2x and 4x upsampling weights. Those of 8x are a parameter.
UP2 = [-0.01716200, -0.03452303, -0.04022174, -0.02921014, -0.00624645, 0.14111091, 0.28896755, 0.00278718, -0.01610267, 0.56661550, 0.03777607, -0.01986694, -0.03144731, -0.01185068, -0.00213539]
UP4 = [
    -0.02419067, -0.03491987, -0.03693351, -0.03094285, -0.00529785, -0.01663432, -0.03556863, -0.03888905, -0.03516850, -0.00989469, 0.23651958, 0.33392945, -0.01073543, -0.01313181, -0.03556694,
    0.13048175, 0.40103025, 0.03951150, -0.02077584, 0.46914198, -0.00209270, -0.01484589, -0.04064806, 0.18942530, 0.56279892, 0.06674400, -0.02335494, -0.03551682, -0.00754830, -0.02267919,
    -0.02363578, 0.00315804, -0.03399098, -0.01359519, -0.00091653, -0.00335467, -0.01163294, -0.01610294, -0.00974088, -0.00191622, -0.01095446, -0.03198464, -0.04455121, -0.02799790, -0.00645912,
    0.06390599, 0.22963888, 0.00630981, -0.01897349, 0.67537268, 0.08483369, -0.02534994, -0.02205197, -0.01667999, -0.00384443,
]


def up_kernels(weights: list[float], n: int) -> np.ndarray:
    """The kernels [ky, kx, row, column] of an n-fold upsampling: a symmetric matrix, given by its upper triangle, is the first quadrant in
    blocks of five; the others are its mirror images."""
    side = 5 * (n // 2)
    full = np.zeros((side, side))
    full[np.triu_indices(side)] = weights
    full += np.triu(full, 1).T
    corner = full.reshape(n // 2, 5, n // 2, 5).swapaxes(1, 2)
    upper = np.concatenate([corner, np.flip(corner, (1, 3))], axis=1)
    return np.concatenate([upper, np.flip(upper, (0, 2))], axis=0)


def upsample(weights: list[float], n: int) -> str:
    """One grid, whose rows meet the n x n places of a cell."""
    kernels = up_kernels(weights, n)
    every = [name("v", dx, dy) for dx, dy in _BOX]
    lo, hi = f"least({','.join(every)})", f"greatest({','.join(every)})"
    sums = ", ".join(f"{weighted('v', {(dx, dy): float(kernels[ky, kx, dy + 2, dx + 2]) for dx, dy in _BOX})} k{ky}_{kx}" for ky in range(n) for kx in range(n))
    cells = " union all ".join(f"select {ky} ky, {kx} kx" for ky in range(n) for kx in range(n))
    one = "case " + " ".join(f"when ky = {ky} and kx = {kx} then k{ky}_{kx}" for ky in range(n) for kx in range(n)) + " end"
    return grid(["v"], 2, "{plane}") + f", m as (select y, x, {lo} lo, {hi} hi, {sums} from g) select {n}*y+ky y, {n}*x+kx x, round(least(greatest({one}, lo), hi), 6) v from m cross join ({cells}) cells"


# The format's factor from quantisation to 1/sigma, and the least sigma that filters.
INV_SIGMA, MIN_SIGMA = -1.1715728752538099024, -3.90524291751269967465540850526868


def inverse_sigma(raw_quant: str, sharpness: str, quant_scale: float = 0.125, quant_mul: float = 0.46) -> str:
    """What the edge filters multiply by, of a block's quantisation and its sharpness from 0 to 7."""
    return f"(1e0/least({quant_mul!r}e0/({quant_scale!r}e0*({raw_quant})*({INV_SIGMA!r}e0))*(({sharpness})/7e0), -1e-4))"


#: A block's quantisation and sharpness from its samples' range and number of positive ones.
_SIGMA = f"sig as (select y @div 8 b_y, x @div 8 b_x, {inverse_sigma('1 + cast(floor((max(c0)-min(c0))*4e0) as int) % 8', 'sum(case when c1 > 0 then 1 else 0 end) % 8')} sigma from {{rgb}} group by 1, 2)"
_PLUS = [(0, 0), (0, -1), (-1, 0), (1, 0), (0, 1)]
_NEAR4 = [(0, -1), (-1, 0), (1, 0), (0, 1)]
_NEAR12 = [(0, -2), (-1, -1), (0, -1), (1, -1), (-2, 0), (-1, 0), (1, 0), (2, 0), (-1, 1), (0, 1), (1, 1), (0, 2)]


def edge_filter(near: list, compared: list, reach: int, mul: float, scale: tuple = (40.0, 5.0, 3.5), border: float = 2 / 3) -> str:
    """Each sample with the samples `near` it, weighted by how alike the samples `compared` around both are; blocks of too small a sigma stay."""
    inv = f"(sigma * case when x % 8 in (0,7) or y % 8 in (0,7) then {1.65 * mul * border!r}e0 else {1.65 * mul!r}e0 end)"
    w = []
    for dx, dy in near:
        sad = "+".join(f"{scale[c]!r}e0*abs({name(f'c{c}', dx + px, dy + py)}-{name(f'c{c}', px, py)})" for c in range(3) for px, py in compared)
        w.append(f"greatest(0e0, 1e0+({sad})*{inv})")
    total = "+".join(f"w{i}" for i in range(len(near)))
    acc = ", ".join(f"round(case when sigma < {MIN_SIGMA!r}e0 then c{c} else (c{c}+" + "+".join(f"w{i}*{name(f'c{c}', *d)}" for i, d in enumerate(near)) + f")/(1e0+{total}) end, 6) c{c}" for c in range(3))
    return grid(["c0", "c1", "c2"], reach, "{rgb}") + f", {_SIGMA}, j as (select g.*, sigma from g join sig on b_y = y @div 8 and b_x = x @div 8), k as (select *, {', '.join(f'{e} w{i}' for i, e in enumerate(w))} from j) select y, x, {acc} from k"


# The format's weights of the low-frequency smoothing.
SIDE, CORNER = 0.20345139757231578, 0.0334829185968739
CENTER = 1 - 4 * (SIDE + CORNER)


def _lf_smoothing(factors: tuple) -> str:
    w = {(dx, dy): (CENTER, SIDE, CORNER)[abs(dx) + abs(dy)] for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    sm = ", ".join(f"{weighted(f'c{c}', w)} s{c}" for c in range(3))
    gap = "greatest(0.5e0, " + ", ".join(f"abs((c{c}-s{c})/{factors[c]!r}e0)" for c in range(3)) + ")"
    inner = "x > 0 and y > 0 and x < n_x-1 and y < n_y-1"
    out = ", ".join(f"round(case when {inner} then (s{c}-c{c})*f+c{c} else c{c} end, 6) c{c}" for c in range(3))
    return grid(["c0", "c1", "c2"], 1, "{rgb}") + f", s as (select *, {sm} from g), t as (select *, greatest(0e0, 3e0-4e0*{gap}) f from s) select y, x, {out} from t"


OPERATORS = {
    "p4_chroma_up_x": Operator("P4", f"with z as ({_sized('{plane}')}), h as ({shifted(['v'], 1, 'x', 'y', 'z')}) select y, 2*x x, round(0.25e0*v_l1+0.75e0*v, 6) v from h union all select y, 2*x+1, round(0.25e0*v_r1+0.75e0*v, 6) from h", ("plane",)),
    "p5_chroma_up_y": Operator("P5", f"with z as ({_sized('{plane}')}), {down(['v'], 1, 'z', 'h')} select 2*y y, x, round(0.25e0*v_u1+0.75e0*v, 6) v from h union all select 2*y+1, x, round(0.25e0*v_d1+0.75e0*v, 6) from h", ("plane",)),
    "p6_gaborish": Operator("P6", grid(["v"], 1, "{plane}") + f" select y, x, round({weighted('v', gaborish_weights(W1, W2))}, 6) v from g", ("plane",)),
    "p7_edge_filter0": Operator("P7", edge_filter(_NEAR12, _PLUS, 3, 0.9), ("rgb",)),
    "p8_edge_filter1": Operator("P8", edge_filter(_NEAR4, _PLUS, 2, 1.0), ("rgb",)),
    "p9_edge_filter2": Operator("P9", edge_filter(_NEAR4, [(0, 0)], 1, 6.5), ("rgb",)),
    "p10_inverse_sigma": Operator("P10", f"select k, l, round({inverse_sigma('c0', 'c2 % 8')}, 6) sigma from {{pix}}", ("pix",)),
    "p11_border_multiplier": Operator("P11", "select y, x, case when x % 8 in (0,7) or y % 8 in (0,7) then 2e0/3e0 else 1e0 end m from {plane}", ("plane",)),
    "p12_upsample2": Operator("P12", upsample(UP2, 2), ("plane",)),
    "p12_upsample4": Operator("P12", upsample(UP4, 4), ("plane",)),
    "p19_convolve_noise": Operator("P19", grid(["v"], 2, "{plane}") + f" select y, x, round(0.16e0*({'+'.join(name('v', *d) for d in _BOX if d != (0, 0))})-3.84e0*v, 6) v from g", ("plane",)),
    "v4_lf_smoothing": Operator("V4", _lf_smoothing((0.5, 0.5, 0.5)), ("rgb",)),
    "v6_nonzeros": Operator("V6", f"with a as (select y, x, abs(v) % 64 n from {{ints}}), b as ({haloed('a', 1)}), t as (select *, lag(n) over (partition by x, blk order by y) t from b), c as (select y, x, n, t, lag(n) over (partition by y order by x) l from t where blk = y @div {BLOCK}) select y, x, n, cast(case when x = 0 and y = 0 then 32 when x = 0 then t when y = 0 then l else (t+l+1) @div 2 end as bigint) predicted from c", ("ints",)),
    # groups come in the order of v; one is rendered when it and the eight around it are there, and its buffer goes when these are rendered
    "t5_group_readiness": Operator("T5", f"{grid(['v'], 2, '{ints}')} select y, x, v arrived, greatest({', '.join(name('v', dx, dy) for dx, dy in _BOX if max(abs(dx), abs(dy)) < 2)}) rendered, greatest({', '.join(name('v', dx, dy) for dx, dy in _BOX)}) freed from g", ("ints",)),
}
#: The flagship: smoothing, then statistics of bands of eight rows.
FLAGSHIP = Operator("P6", grid(["v"], 1, "{plane}") + f", s as (select y, {weighted('v', gaborish_weights(W1, W2))} v from g) select y @div 8 band, count(*) n, round(avg(v), 6) mean_v, round(min(v), 6) min_v, round(max(v), 6) max_v from s group by 1", ("plane",))
OPERATORS["flagship_band_statistics"] = FLAGSHIP
