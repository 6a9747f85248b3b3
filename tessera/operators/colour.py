"""Pointwise colour stages over (y, x, c0, c1, c2): no shuffle, one projection in whole-stage code."""

from __future__ import annotations

import numpy as np

from tessera.functions import primaries as pr
from tessera.functions import transfer as t
from tessera.relational import Operator


def _three(id_, exprs, **kw):
    return Operator(id_, "select y, x, " + ", ".join(f"round({e}, 6) c{i}" for i, e in enumerate(exprs)) + " from {rgb}", ("rgb",), **kw)


def _each(id_, f):
    return _three(id_, [f(f"c{i}") for i in range(3)])


_LIN = [f"c{i}*0.5e0" for i in range(3)]
_LUM = (0.2627, 0.678, 0.0593)


def _matrix(id_, m):
    return _three(id_, ["+".join(f"({float(v)!r}+0e0)*c{i}" for i, v in enumerate(row)) for row in m])


def _pick(column, names):
    return f"case {column} % {len(names)} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


_NAMES = "select k, l, " + ", ".join(f"{_pick(c, n)} {a}" for c, n, a in (("l", ("RGB", "Gra", "XYB"), "space"), ("c0", tuple(pr.WHITE_POINTS), "white"), ("c1", tuple(pr.PRIMARIES), "prim"), ("c2", pr.TRANSFERS, "trans"), ("k", pr.INTENTS, "intent"))) + " from {pix}"
_POINTS = " union all ".join(f"select '{n}' name, {x!r}+0e0 x, {y!r}+0e0 y" for n, (x, y) in pr.WHITE_POINTS.items())
_BT2100 = (pr.PRIMARIES["202"], pr.WHITE_POINTS["D65"])



def output_matrix(primaries, white) -> list[tuple]:
    """The inverse opsin matrix for linear RGB of other primaries: through XYZ, both sides adapted to D50."""
    srgb = pr.adapt_to_d50(pr.WHITE_POINTS["D65"]) @ pr.rgb_to_xyz(pr.PRIMARIES["SRG"], pr.WHITE_POINTS["D65"])
    target = pr.adapt_to_d50(white) @ pr.rgb_to_xyz(primaries, white)
    return [tuple(map(float, row)) for row in np.linalg.solve(target, srgb) @ np.array(t.OPSIN)]


def grey_matrix() -> list[tuple]:
    """Each channel the luminance of the sRGB primaries."""
    lum = pr.rgb_to_xyz(pr.PRIMARIES["SRG"], pr.WHITE_POINTS["D65"])[1]
    return [tuple(map(float, lum @ np.array(t.OPSIN)))] * 3


#: An integer's bits as a float of 16: sign, five bits of exponent, ten of fraction.
_HALF = "(case when i >= 32768 then -1e0 else 1e0 end * case when (i >> 10) % 32 = 0 then (i % 1024)*pow(2e0, -24) else (1024e0+i % 1024)*pow(2e0, cast((i >> 10) % 32 as int)-25) end)"
_M3 = "select k, l, c0*1e0 a, 1e0 b, 2e0 c, c1*1e0 d, 3e0 e, 1e0 f, c2*1e0 g, 1e0 h, 5e0 i from {pix}"
_COFACTORS = ["e*i-f*h", "c*h-b*i", "b*f-c*e", "f*g-d*i", "a*i-c*g", "c*d-a*f", "d*h-e*g", "b*g-a*h", "a*e-b*d"]
OPERATORS = {
    "p1_convert_u8": Operator("P1", "select k, l, c0/255e0 v0, c1/255e0 v1 from {pix}", ("pix",)),
    "p2_convert_int": Operator("P2", "select k, l, c0/(pow(2e0, @bits)-1e0) v0, c1/(pow(2e0, @bits)-1e0) v1 from {pix}", ("pix",), {"bits": 6}),
    "p2_convert_half": Operator("P2", f"with b as (select k, l, cast(c0*1200 + c1*100 + c2 as int) i from {{pix}}) select k, l, i, {_HALF} v from b where (i >> 10) % 32 < 31", ("pix",)),
    "p23_output_bt2100": _three("P23", t.xyb_to_linear("c0*0.05e0", "c1", "c2", m=output_matrix(*_BT2100))),
    "p23_output_grey": _three("P23", t.xyb_to_linear("c0*0.05e0", "c1", "c2", m=grey_matrix())),
    "p3_modular_xyb": _three("P3", ["c1*0.0078125e0", "c0*0.001953125e0", "(c2+c0)*0.00390625e0"]),
    "p13_nearest_up2": Operator("P13", "select 2*p.y+a.i y, 2*p.x+b.i x, v from {plane} p, (select 0 i union all select 1) a, (select 0 i union all select 1) b", ("plane",)),
    "p21_ycbcr": _three("P21", t.ycbcr_to_rgb("c0", "c1", "c2")),
    "p22_xyb_linear": _three("P22", t.xyb_to_linear("c0*0.05e0", "c1", "c2")),
    "p24_from_linear_srgb": _each("P24", t.srgb),
    "p24_from_linear_bt709": _each("P24", t.bt709),
    "p24_from_linear_pq": _each("P24", lambda v: t.pq(v, 255)),
    "p24_from_linear_hlg": _three("P24", [t.hlg(c) for c in t.hlg_ootf(["abs(c0)", "abs(c1)", "abs(c2)"], _LUM, 1000, True)]),
    "p24_from_linear_gamma": _each("P24", lambda v: t.gamma(v, 0.45455)),
    "p25_to_linear_srgb": _each("P25", t.srgb_inverse),
    "p25_to_linear_bt709": _each("P25", t.bt709_inverse),
    "p25_to_linear_pq": _each("P25", lambda v: t.pq_inverse(f"least(abs({v}),1e0)", 255)),
    "p25_to_linear_hlg": _three("P25", t.hlg_ootf([f"({t.hlg_inverse(f'abs(c{i})')})" for i in range(3)], _LUM, 1000)),
    "p25_to_linear_gamma": _each("P25", lambda v: t.gamma(v, 2.2)),
    "p29_spot": _three("P29", [f"0.5e0*least(greatest(c2,0e0),1e0)*{s}+(1e0-0.5e0*least(greatest(c2,0e0),1e0))*c{i}" for i, s in enumerate(("0.8e0", "0.2e0", "0.4e0"))]),
    "f7_fast_math": Operator("F7", f"select y, x, round({t.erf('v')}, 6) erf, round(cos(v), 6) cos, round(pow(2e0, v), 6) pow2, round(log2(abs(v)+1e0), 6) log2 from {{plane}}", ("plane",)),
    "f8_rational": Operator("F8", "select y, x, round((0.5e0+v*(0.25e0+v*0.125e0))/(1e0+abs(v)*(0.5e0+abs(v)*0.25e0)), 6) v from {plane}", ("plane",)),
    "f12_primaries_to_xyz": _matrix("F12", pr.rgb_to_xyz(*_BT2100)),
    "f12_adapted_to_d50": _matrix("F12", pr.adapt_to_d50(_BT2100[1]) @ pr.rgb_to_xyz(*_BT2100)),
    "f13_white_points": Operator("F13", f"select n.k, n.l, n.white, round(w.x, 6) wx, round(w.y, 6) wy from ({_NAMES}) n join ({_POINTS}) w on w.name = n.white", ("pix",)),
    "f14_description": Operator("F14", f"select k, l, {pr.description('space', 'white', 'prim', 'trans', 'intent')} d from ({_NAMES}) n", ("pix",)),
    "f9_matrix3": _three("F9", ["0.4124e0*c0+0.3576e0*c1+0.1805e0*c2", "0.2126e0*c0+0.7152e0*c1+0.0722e0*c2", "0.0193e0*c0+0.1192e0*c1+0.9505e0*c2"]),
    "f9_inverse": Operator("F9", f"with m as ({_M3}), d as (select *, a*(e*i-f*h)-b*(d*i-f*g)+c*(d*h-e*g) det from m) select k, l, " + ", ".join(f"case when abs(det) < 1e-12 then null else ({x})/det + 0e0 end m{n // 3}{n % 3}" for n, x in enumerate(_COFACTORS)) + " from d", ("pix",)),
    "f9_product": Operator("F9", f"with m as ({_M3}) select k, l, " + ", ".join("+".join(f"{'abcdefghi'[3 * r + j]}*{'abcdefghi'[3 * j + c]}" for j in range(3)) + f" p{r}{c}" for r in range(3) for c in range(3)) + " from m", ("pix",)),
    "f16_table_curves": Operator("F16", f"with p as (select k, l, c0/50e0 x from {{pix}}) select k, l, round({t.hlg_inverse('x')}, 6) hlg, round({t.pq_inverse('x')}, 6) pq from p", ("pix",)),
    "f17_u16_to_u8": Operator("F17", "with p as (select k, l, c0*1300+c1 v from {pix}) select k, l, cast((v*255+32768) @div 65535 as int) u16, cast((v*65535*255+2147483648) @div 4294967295 as int) u32 from p", ("pix",)),
    "f17_to_u8": Operator("F17", f"select y, x, {t.to_u8('c0')} c0, {t.to_u8('c1')} c1, {t.to_u8('c2')} c2 from {{rgb}}", ("rgb",)),
    "v1_lf_cfl": _three("V1", ["c1*0.03125e0*1.5e0+c0*0.25e0", "c0*0.0625e0", "c2*0.125e0+c0*0.75e0"]),
    "v13_cfl_factors": Operator("V13", "select k, l, 0e0 + c1/@f y_to_x, 1e0 + c2/@f y_to_b from {pix}", ("pix",), {"f": "84e0"}),
}

# P20: noise over XYB; the strength is a lookup table read with linear interpolation.
_LUT = [0.0, 0.05, 0.1, 0.2, 0.3, 0.35, 0.4, 0.5]


def strength(v: str) -> str:
    s = f"greatest(0e0, 6e0*({v}))"
    lut = " ".join(f"when {i} then {{}}".replace("{}", f"{_LUT[i]!r}e0+({s}-{i}e0)*({_LUT[i + 1] - _LUT[i]!r}e0)") for i in range(7))
    return f"least(greatest(case when {s} >= 7e0 then {_LUT[7]!r}e0 else case cast(floor({s}) as int) {lut} end end, 0e0), 1e0)"


_G, _R = strength("(c1-c0)*0.5e0"), strength("(c1+c0)*0.5e0")
_NR, _NG = "(0.0078125e0*0.22e0*c0+0.9921875e0*0.22e0*c2)", "(0.0078125e0*0.22e0*c1+0.9921875e0*0.22e0*c2)"
OPERATORS["p20_add_noise"] = Operator("P20", f"with n as (select y, x, c0, c1, c2, {_R}*{_NR} r, {_G}*{_NG} g from {{rgb}}) select y, x, round(c0+0.1e0*(r+g)+r-g, 6) c0, round(c1+r+g, 6) c1, round(c2+0.9e0*(r+g), 6) c2 from n", ("rgb",))

# P27: the eight blend modes over foreground and background pixels with an alpha each, associated or not.
_FA, _BA = "least(greatest(fa,0e0),1e0)", "least(greatest(ba,0e0),1e0)"
_OVER = "(1e0-(1e0-{a})*(1e0-{b}))"
BLENDS = {
    "none": ("bg", "ba"),
    "replace": ("fg", "fa"),
    "add": ("bg+fg", "ba+fa"),
    "mul": ("bg*least(greatest(fg,0e0),1e0)", "ba*fa"),
    "weighted_above": (f"bg+fg*{_FA}", "ba"),
    "weighted_below": (f"fg+bg*{_BA}", "fa"),
    "above_associated": (f"fg+bg*(1e0-{_FA})", _OVER.format(a=_FA, b=_BA)),
    "above": (f"case when {_OVER.format(a=_FA, b='ba')} > 0e0 then (fg*{_FA}+bg*ba*(1e0-{_FA}))/{_OVER.format(a=_FA, b='ba')} else 0e0 end", _OVER.format(a=_FA, b="ba")),
    # without an alpha channel a blend copies and a weighted sum is a sum; without clamping alpha is taken as it is
    "above_opaque": ("fg", "fa"),
    "weighted_opaque": ("bg+fg", "ba"),
    "mul_unclamped": ("bg*fg", "ba*fa"),
    "above_unclamped": (f"case when {_OVER.format(a='wa', b='ba')} > 0e0 then (fg*wa+bg*ba*(1e0-wa))/{_OVER.format(a='wa', b='ba')} else 0e0 end", _OVER.format(a="wa", b="ba")),
    "weighted_unclamped": ("bg+fg*wa", "ba"),
    "below_associated": (f"bg+fg*(1e0-{_BA})", _OVER.format(a=_BA, b=_FA)),
    "below": (f"case when {_OVER.format(a=_BA, b='fa')} > 0e0 then (bg*{_BA}+fg*fa*(1e0-{_BA}))/{_OVER.format(a=_BA, b='fa')} else 0e0 end", _OVER.format(a=_BA, b="fa")),
}
for _name, (_c, _a) in BLENDS.items():
    OPERATORS[f"p27_blend_{_name}"] = Operator("P27", f"with p as (select y, x, c0 fg, c1 bg, least(greatest(c2+0.5e0,0e0),1e0) fa, least(greatest(0.5e0-c2,0e0),1e0) ba, c2+0.5e0 wa from {{rgb}}) select y, x, round({_c}, 6) c, round({_a}, 6) a from p", ("rgb",))
